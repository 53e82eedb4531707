"""Rewrite tables, rule weights and thresholds.

Nothing here is logic; results depend on these exact entries and their order.
"""

# Misspellings rewritten by the category profile, applied in this order.
CATEGORY_VARIANTS = [
    ("maderchood", "madarchod"), ("maderchod", "madarchod"), ("madarchood", "madarchod"),
    ("motherchod", "madarchod"), ("m@d@rch0d", "madarchod"), ("m4d4rch0d", "madarchod"),
    ("benchood", "bhenchod"), ("benchod", "bhenchod"), ("banchod", "bhenchod"),
    ("b3nch0d", "bhenchod"), ("b@nch0d", "bhenchod"),
    ("madrchod", "madarchod"), ("mdrchod", "madarchod"),
    ("fukk", "fuck"), ("fuuk", "fuck"), ("fuk", "fuck"), ("phuck", "fuck"), ("f*ck", "fuck"),
    ("f**k", "fuck"), ("fck", "fuck"), ("fvck", "fuck"), ("f4ck", "fuck"), ("fu2k", "fuck"), ("f@ck", "fuck"),
    ("shyt", "shit"), ("sht", "shit"), ("sh1t", "shit"), ("$hit", "shit"), ("sh*t", "shit"),
    ("shiit", "shit"), ("shitt", "shit"),
    ("btch", "bitch"), ("b1tch", "bitch"), ("b*tch", "bitch"), ("bi7ch", "bitch"),
    ("biatch", "bitch"), ("biotch", "bitch"), ("b!tch", "bitch"),
    ("a55", "ass"), ("a$$", "ass"), ("@ss", "ass"), ("azz", "ass"), ("as$", "ass"), ("a$s", "ass"), ("4ss", "ass"),
    ("azzhole", "asshole"), ("a$$hole", "asshole"), ("@sshole", "asshole"),
    ("assh0le", "asshole"), ("a55hole", "asshole"),
    ("id10t", "idiot"), ("1d10t", "idiot"), ("idi0t", "idiot"),
    ("st*pid", "stupid"), ("stup1d", "stupid"), ("$tupid", "stupid"),
    ("dum@ss", "dumbass"), ("dumb@ss", "dumbass"), ("dumb4ss", "dumbass"),
    ("l0ser", "loser"), ("l05er", "loser"), ("lo$er", "loser"),
    ("h8", "hate"), ("h8r", "hater"), ("h@te", "hate"),
    ("kil", "kill"), ("k1ll", "kill"), ("k!ll", "kill"),
]

# Misspellings rewritten by the config profile, applied in this order.
CONFIG_VARIANTS = [
    ("maderchood", "madarchod"), ("maderchod", "madarchod"), ("madarchood", "madarchod"),
    ("motherchod", "madarchod"), ("benchood", "bhenchod"), ("benchod", "bhenchod"), ("banchod", "bhenchod"),
    ("fukk", "fuck"), ("fuuk", "fuck"), ("fuk", "fuck"), ("phuck", "fuck"),
    ("shyt", "shit"), ("sht", "shit"), ("sh1t", "shit"),
    ("btch", "bitch"), ("b1tch", "bitch"), ("biatch", "bitch"),
    ("a55", "ass"), ("a$$", "ass"), ("azz", "ass"), ("azzhole", "asshole"), ("a$$hole", "asshole"),
]

# Single-character substitutions per profile (from, to).
LEET = {
    "legacy": ("431057@$!", "aeiostasi"),
    "category": ("@431!057$+", "aaeiiostst"),
    "config": ("@431!057$+8692", "aaeiioststbggz"),
}

# Multi-character shapes per profile, applied in this order.
SHAPES = {
    "category": [("||", "ll"), ("|\\", "n"), ("|/|", "m"), ("//", "w"), ("><", "x"), ("|<", "k")],
    "config": [
        ("|-|", "h"), ("|<", "k"), ("|\\/|", "m"), ("|\\|", "n"),
        ("|_|", "u"), ("\\/\\/", "w"), ("><", "x"), ("/\\", "a"),
    ],
}

# Language indicators of the config profile.
LANGUAGE_INDICATORS = {
    "hindi": {
        "script": "[\\x{0900}-\\x{097F}]",
        "words": """
            teri mera tumhara aapka hamara maa baap behen bhai beta kya kaise kaha kab kyun hai hain tha thi
            the aur ya lekin magar par chutiya gandu madarchod bhenchod ullu patha gaand lund randi harami
            kutte bhosdike chod kaminey bewakoof bakchod saala kamina
        """.split(),
        "phrases": ["teri maa", "tera baap", "bhad mein", "mar ja"],
    },
    "marathi": {
        "script": "[\\x{0900}-\\x{097F}]",
        "words": """
            tujhi majhi tyachi tichi amchi aai baba bahin bhau mulga kay kasa kuthe kadhi kashala aahe aahes
            aahet hota hoti ani kinva pan paran tar bokya gandya lavdya bhikari zavadya randecha bhadvya shendya
        """.split(),
        "phrases": ["tujhi aai", "aai ghalya", "tujhya aaichi"],
    },
    "english": {
        "script": "[A-Za-z]",
        "words": """
            the is are was were you your yours yourself stupid idiot moron dumb retard fuck shit bitch ass damn
        """.split(),
        "phrases": ["fuck you", "go to hell", "kiss my"],
    },
}
DEFAULT_LANGUAGE = "english"
MIN_INDICATOR_WORDS = 2

# Context rules of the config profile.
CONTEXT_PUNCTUATION = [
    ("excessive_exclamation", "!{3,}", 0.1),
    ("excessive_question", r"\?{3,}", 0.1),
    ("mixed_aggressive_punctuation", "[!?]{3,}", 0.15),
]
CONTEXT_CAPS = [("caps_lock_aggression", 0.5, 0.15), ("shouting_words", 0.5, 0.1)]
CONTEXT_PRONOUNS = ["you", "your", "yours", "yourself", "u", "ur", "urs"]
CONTEXT_PRONOUN_MIN, CONTEXT_PRONOUN_WEIGHT = 2, 0.2
CONTEXT_COMMANDS = [
    (["should", "must", "need to", "have to", "better"], 0.15),
    (["go", "get", "stop", "shut"], 0.1),
]

# Weights of the config profile.
CONFIG_WEIGHTS = {"word": 0.3, "phrase": 0.5, "pattern": 0.4}
CONFIG_GAP_SCORES = [1.0, 0.8, 0.6]
CONFIG_COUNT_BOOST = {2: 1.2, 3: 1.4, 4: 1.6}
CONFIG_CONTEXT_MAX = 0.3
CONFIG_AGGRESSION_MIN = 0.3
CONFIG_SEVERITY_THRESHOLDS = {"critical": 0.9, "high": 0.7, "medium": 0.4, "low": 0.2}

# Intent rules (intent, pattern, weight).
INTENT_RULES = [
    ("threat", r"\b(kill|hurt|harm|destroy|end)\s+(you|yourself)\b", 0.3),
    ("threat", r"\bi\s+will\s+(hurt|kill|destroy)\b", 0.3),
    ("threat", r"\bwatch\s+out\b", 0.3),
    ("insult", r"\byou\s+are\s+(so\s+)?(stupid|ugly|worthless|pathetic)\b", 0.4),
    ("insult", r"\bsuch\s+a\s+(loser|idiot|freak)\b", 0.4),
    ("insult", r"\bi\s+hate\s+you\b", 0.4),
    ("insult", r"\bhate\s+you\b", 0.4),
    ("exclusion", r"\bnobody\s+(likes|wants|cares)\s+(about\s+)?you\b", 0.4),
    ("exclusion", r"\byou\s+don't\s+belong\b", 0.4),
]
INTENT_ORDER = ["threat", "insult", "exclusion", "harassment", "encouragement_of_harm"]

# Polite phrases and words that switch off weak hits.
POLITE_PHRASES = [
    "thank you", "thanks", "please", "sorry", "excuse me",
    "good morning", "good afternoon", "good evening", "good night",
    "nice to meet you", "how are you", "pleased to meet",
    "have a good day", "take care", "welcome", "congratulations",
    "happy birthday", "best wishes",
]
POLITE_WORDS = ["please", "thank", "thanks", "sorry", "welcome", "congratulations"]

# Style patterns of the category profile, matched on lower-cased text.
SECOND_PERSON = r"\b(you|your|yourself|you're|you'll|you've)\b"
DIRECT_ADDRESS = r"\b(hey you|listen you|you there)\b"
POSSESSIVE_ATTACK = r"\byour\s+(face|mother|family|life|problem)\b"
AGGRESSIVE_COMMANDS = r"\b(shut up|go away|get lost|leave me alone|stop it|quit it|go die|kill yourself)\b"
DEMANDS = r"\b(you should|you must|you need to|you have to|you better)\s+\w+"
THREAT_IMPERATIVES = r"\b(i will|i'll|gonna|going to)\s+(hurt|kill|destroy|get|beat)\b"

# Word importance for adaptive phrase matching.
STRONG_WORDS = """
    kill die suicide hurt harm destroy end stupid idiot ugly worthless pathetic hate loser freak nobody alone
""".split()
ADDRESS_WORDS = "you your yourself are should must go get make feel".split()
FLEXIBLE_WORDS = "kill die hate stupid ugly worthless".split()

# Single words that never count as the whole message.
NEVER_ALONE = ["die", "kill", "hurt", "harm", "end"]

# Threshold modes and severity bands.
MODE_THRESHOLDS = {"standard": 0.7, "strict": 0.9, "lenient": 0.5}
SEVERITY_BANDS = [("low", 0.3), ("medium", 0.6), ("high", 0.8), ("critical", 0.95)]

# Severity ranks, actions and message templates.
SEVERITIES = ["none", "low", "medium", "high", "critical"]
ACTIONS = ["ignore", "warn", "block", "escalate", "report"]
SAFE_TEXT = "No cyberbullying detected. The message appears to be safe."

# Limits.
MAX_TEXT_LENGTH = 5000
MAX_TERM_LENGTH = 50
BATCH_SIZE = 100
RATE_LIMIT, RATE_BURST = 60, 10
RATE_LIMIT_PRODUCTION, RATE_BURST_PRODUCTION = 30, 5
CACHE_TTL_SECONDS = 3600
METRICS_SECONDS = 60
ALERT_ERRORS, ALERT_LATENCY = 10, 5000
ALERT_ERRORS_PRODUCTION, ALERT_LATENCY_PRODUCTION = 5, 2000

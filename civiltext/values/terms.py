"""The term lists every scoring profile starts from.

Each list is data that must hold exactly these entries for results to agree
with the published behaviour of the profiles; nothing here is logic.
"""

# Built-in defaults of the multilingual profile.
DEFAULT_LANGUAGES = {
    "english": {
        "words": "stupid idiot loser ugly fat die kill".split(),
        "phrases": ["kill yourself", "nobody likes you", "go die", "you should die", "go kill yourself"],
        "patterns": [r"\byou\s+are\s+(so\s+)?(stupid|ugly|worthless)"],
        "severity": {
            "kill yourself": "high", "go die": "high", "you should die": "high", "go kill yourself": "high",
            "stupid": "medium", "ugly": "medium", "die": "low", "kill": "low",
        },
    },
    "hindi": {
        "words": "chutiya gandu harami kutte nalayak gaand".split(),
        "phrases": ["teri maa ki", "ullu ka patha", "gaand maaru", "teri maa ka"],
        "patterns": [r"\bteri\s+maa\s+ki\b", r"\bgaand\s+maa?r", r"तेरी\s*माँ\s*की", r"चुतिया"],
        "severity": {
            "madarchod": "high", "chutiya": "medium", "nalayak": "low",
            "teri maa ki": "high", "ullu ka patha": "medium",
        },
    },
    "marathi": {
        "words": "bokya gandya lavdya bhikari".split(),
        "phrases": ["aai ghalya", "tujhi aai"],
        "patterns": [r"\btujhi\s+aai\b"],
        "severity": {"aai ghalya": "high", "bokya": "medium", "lavdya": "medium", "gandya": "medium"},
    },
}

# The shipped term file, merged on top of the defaults.
SHIPPED_LANGUAGES = {
    "english": {
        "words": """
            dyke jhalla douche paagal hijra jerk langda chappri pathetic bhand bhikari takla bakwas keeda
            dumbass disgusting jhakkas chakke faggot nobody kachra dumb baklol failure gross cheap haddi
            kaamchor pussy chinar asshole sukda sissy dhakkan weirdo retard moron stalker lafanga lunatic
            duffer nalak nalla benchood outcast katela waste gay madarchood hatela lavdya creep coward
            garbage kanjar crazy freak pervert bastard weakling racist andha scumbag nazi tapori slut sicko
            chipkali chirkut bawla ugly mote trash fat khotya homo meetha chapri loser whore nasty ghatiya
            kutta psycho nalaayak terrorist bitch idiot kamchor stupid haraamkhor haraami faltu worthless
            tharki useless skinny besharam bigot friendless maderchood jhatu gandya bokya alone mental nig
        """.split(),
        "phrases": [],
        "patterns": [r"\byou\s+are\s+(so\s+)?(stupid|ugly|worthless)"],
        "severity": {
            "kill yourself": "high", "go die": "high", "you should die": "high", "go kill yourself": "high",
            "stupid": "medium", "ugly": "medium", "die": "low", "kill": "low",
            "benchood": "high", "maderchood": "high",
        },
    },
    "hindi": {
        "words": """
            nalayak maderchod chod bevakuf suar gaandu motherchod maada bhosdike randi lund gandu gaand ullu
            madarchod bhenchod harami benchod chodu kaminey chutiya kutte banchod bakchod bewakoof haraamkhor
        """.split(),
        "phrases": ["tera baap ka"],
        "patterns": [r"\bteri\s+maa\s+ki\b", r"\bgaand\s+maa?r"],
        "severity": {
            "madarchod": "high", "chutiya": "high", "nalayak": "low", "teri maa ki": "high",
            "ullu ka patha": "medium", "bhenchod": "high", "benchod": "high",
        },
    },
    "marathi": {
        "words": "bokya gandya lavdya bhikari".split(),
        "phrases": ["aai ghalya", "tujhi aai"],
        "patterns": [r"\btujhi\s+aai\b"],
        "severity": {"aai ghalya": "high", "bokya": "medium", "lavdya": "medium", "gandya": "medium"},
    },
}

# Native-script insults looked up as substrings of the raw text.
NATIVE_PHRASES = {
    "hindi": {"चुतिया": "medium", "चूतिया": "medium", "तेरी माँ की": "high", "तेरी मां की": "high"},
}

# Words too ambiguous to count alone; phrases still cover them.
CONTEXT_ONLY_WORDS = {"english": ["nobody", "die", "kill"]}

# Defaults of the legacy profile.
LEGACY_WORDS = ["stupid", "idiot", "loser", "ugly", "fat", "worthless"]
LEGACY_PHRASES = ["kill yourself", "nobody likes you", "you suck"]
LEGACY_SEVERITY = {
    "annoying": "low", "weird": "low", "stupid": "medium", "ugly": "medium",
    "kill yourself": "high", "worthless": "high",
}

# Substrings that mark a term as romanised Hindi.
HINDI_MARKERS = [
    "chutiya", "bhosdike", "gandu", "lund", "gaand", "randi", "harami",
    "kutte", "suar", "nalayak", "bevakuf", "ullu", "kaminey", "madarchod",
    "bhenchod", "chod", "teri", "maa", "behen", "baap", "bewakoof",
]

# Substrings that decide a term's category.
THREAT_STEMS = ["kill", "die", "hurt", "harm", "destroy", "end"]
PROFANITY_STEMS = ["chod", "fuck", "bitch", "ass", "shit"]
THREAT_PHRASES = ["kill yourself", "go die", "you should die", "kys"]
NOT_INSULT_PHRASE_STEMS = ["nobody", "kill", "die"]
EXCLUSION_PHRASE_STEMS = ["nobody", "alone", "friendless"]

# Per-category settings used when terms are regrouped by category.
CATEGORY_SETTINGS = {
    "direct_insults": {
        "severity": "medium", "boost": 0.4, "words": [],
        "patterns": [r"\byou\s+are\s+(so\s+)?(stupid|ugly|worthless)", r"\bgo\s+die\b"],
    },
    "threats": {
        "severity": "high", "boost": 0.6, "words": [],
        "patterns": [r"\bkill\s+yourself\b", r"\bi\s+will\s+hurt\s+you\b", r"\bkys\b"],
    },
    "social_exclusion": {
        "severity": "medium", "boost": 0.4, "words": ["friendless", "alone", "outcast", "nobody"],
        "patterns": [r"\bnobody\s+(likes|wants|cares)\s+(about\s+)?you\b"],
    },
    "harassment": {
        "severity": "medium", "boost": 0.35, "words": ["freak", "weirdo", "creep", "stalker"],
        "patterns": [r"\byou\s+(creep|freak)\b"],
    },
}

# Category file used when no term file is present.
DEFAULT_CATEGORIES = {
    "direct_insults": {
        "keywords": ["stupid", "idiot", "loser", "ugly", "fat", "worthless", "pathetic"],
        "patterns": [r"\byou\s+are\s+(so\s+)?(stupid|ugly|worthless)", r"\bgo\s+die\b"],
        "severity": "medium", "confidence_boost": 0.3,
    },
    "threats": {
        "keywords": ["kill", "hurt", "harm", "destroy", "end you"],
        "patterns": [r"\bkill\s+yourself\b", r"\bi\s+will\s+hurt\s+you\b"],
        "severity": "high", "confidence_boost": 0.5,
    },
    "social_exclusion": {
        "keywords": ["nobody likes you", "friendless", "alone", "outcast"],
        "patterns": [r"\bnobody\s+(likes|wants)\s+you\b"],
        "severity": "medium", "confidence_boost": 0.4,
    },
    "harassment": {
        "keywords": ["freak", "weirdo", "creep", "stalker"],
        "patterns": [r"\byou\s+(creep|freak)\b"],
        "severity": "medium", "confidence_boost": 0.35,
    },
}

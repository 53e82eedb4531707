"""Style, targeting, command and intent features of a message as struct columns.

Each feature struct has a ``score`` and an ``indicators`` array, plus its counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiltext.functions.staging import guarded, let
from civiltext.functions.text import (
    NOT_SPACE, WORD_CHARS, col, count, count_chars, has, sentences, whitespace_words,
)
from civiltext.values import rules


def _sum(*parts: Column) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return total


def _points(*cases: tuple[Column, float]) -> Column:
    """Points of the first case that holds, else 0."""
    out = F.lit(0.0)
    for cond, points in reversed(cases):
        out = F.when(cond, F.lit(points)).otherwise(out)
    return out


def _names(*cases: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for cond, name in reversed(cases):
        out = F.when(cond, name).otherwise(out)
    return out


def _feature(groups: list[list[tuple[Column, float, str]]], **extra: Column) -> Column:
    """Struct of summed points and names; each group yields at most one of its cases."""
    score = _sum(*[_points(*[(c, p) for c, p, _ in g]) for g in groups])
    names = F.array_compact(F.array(*[_names(*[(c, n) for c, _, n in g]) for g in groups]))
    return F.struct(score.alias("score"), names.alias("indicators"), *[v.alias(k) for k, v in extra.items()])


def _counted(counts: dict[str, Column], body) -> Column:
    """Count once per row, then score the counts."""
    return let(F.struct(*[c.alias(n) for n, c in counts.items()]), body)


def caps_features(text: Column | str) -> Column:
    """Capitals: share among letters and runs of four or more (F1)."""
    text = col(text)
    capitals = count_chars(text, r"\p{Lu}")
    counts = {
        "capitals": capitals,
        "letters": count_chars(text, r"\p{L}"),
        "runs": F.when(has(text, "[A-Z]{4}"), count(text, "[A-Z]{4,}")).otherwise(0),
    }

    def body(c: Column) -> Column:
        ratio, runs = F.coalesce(F.try_divide(c["capitals"], c["letters"]), F.lit(0.0)), c["runs"]
        return _feature(
            [
                [(ratio > 0.7, 0.25, "excessive_caps"), (ratio > 0.5, 0.15, "high_caps"), (ratio > 0.3, 0.1, "moderate_caps")],
                [(runs > 2, 0.15, "multiple_caps_sequences"), (runs > 0, 0.1, "caps_sequence")],
            ],
            caps_ratio=ratio, caps_sequences=runs,
        )

    return _counted(counts, body)


def punct_features(text: Column | str, n_words: Column | None = None) -> Column:
    """Punctuation: runs of marks, mixed runs, long dots and density in short texts (F2)."""
    text = col(text)
    none = F.lit(0)
    counts = {
        "bangs": guarded(text, ["!!"], count(text, "!{2,}"), none),
        "asks": guarded(text, ["??"], count(text, r"\?{2,}"), none),
        "mixed": guarded(text, ["!!", "??", "!?", "?!"], count(text, "[?!]{3,}"), none),
        "dots": guarded(text, ["...."], count(text, r"\.{4,}"), none),
        "n": F.size(whitespace_words(text)) if n_words is None else n_words,
    }

    def body(c: Column) -> Column:
        density = (c["bangs"] + c["asks"] + c["mixed"]) / F.greatest(c["n"], F.lit(1))
        return _feature(
            [
                [(c["bangs"] > 2, 0.2, "very_excessive_exclamation"), (c["bangs"] > 0, 0.1, "excessive_exclamation")],
                [(c["mixed"] > 0, 0.15, "mixed_aggressive_punctuation")],
                [(c["dots"] > 0, 0.05, "ellipsis_abuse")],
                [((c["n"] < 10) & (density > 0.5), 0.1, "high_punctuation_density")],
            ],
            excessive_exclamation=c["bangs"], excessive_question=c["asks"], mixed_punct=c["mixed"],
        )

    return _counted(counts, body)


def targeting_features(text: Column | str, n_words: Column | None = None, low: Column | None = None) -> Column:
    """Second person: density, direct address, possessive attacks (F3). ``low``: the text in lower case, where it is known."""
    text = col(text)
    low = F.lower(text) if low is None else low
    counts = {
        "second": guarded(low, ["you"], count(low, rules.SECOND_PERSON), F.lit(0)),
        "direct": guarded(low, ["you"], has(low, rules.DIRECT_ADDRESS), F.lit(False)),
        "attacks": guarded(low, ["your"], count(low, rules.POSSESSIVE_ATTACK), F.lit(0)),
        "parts": guarded(low, ["you"], F.size(sentences(text)), F.lit(0)),
        "n": F.size(whitespace_words(text)) if n_words is None else n_words,
    }

    def body(c: Column) -> Column:
        density = c["second"] / F.greatest(c["n"], F.lit(1))
        high = F.when(c["n"] < 10, 0.4).otherwise(0.3)
        medium = F.when(c["n"] < 10, 0.2).otherwise(0.15)
        return _feature(
            [
                [(density > high, 0.25, "high_personal_targeting"), (density > medium, 0.15, "moderate_personal_targeting")],
                [(c["direct"], 0.2, "direct_aggressive_address")],
                [(c["attacks"] > 0, 0.3, "possessive_attack_pattern")],
                [((c["second"] > 3) & (c["parts"] <= 2), 0.1, "concentrated_targeting")],
            ],
            targeting_density=density, second_person_count=c["second"], possessive_attacks=c["attacks"],
        )

    return _counted(counts, body)


def command_features(text: Column | str, low: Column | None = None) -> Column:
    """Imperatives: aggressive commands, demands and threats."""
    low = F.lower(col(text)) if low is None else low
    commands = ["shut up", "go away", "get lost", "leave me", "stop it", "quit it", "go die", "kill yourself"]
    acts = ["hurt", "kill", "destroy", "get", "beat"]
    threats = guarded(low, ["i will", "i'll", "gonna", "going to"], count(low, rules.THREAT_IMPERATIVES), F.lit(0))
    counts = {
        "commands": guarded(low, commands, count(low, rules.AGGRESSIVE_COMMANDS), F.lit(0)),
        "demands": guarded(low, ["you "], count(low, rules.DEMANDS), F.lit(0)),
        "threats": guarded(low, acts, threats, F.lit(0)),
    }

    def body(c: Column) -> Column:
        return _feature(
            [
                [(c["commands"] > 0, 0.4, "aggressive_commands")],
                [(c["demands"] > 0, 0.2, "demanding_language")],
                [(c["threats"] > 0, 0.5, "threatening_imperatives")],
            ],
            aggressive_commands=c["commands"], demands=c["demands"], threats=c["threats"],
        )

    return _counted(counts, body)


def emphasis_features(text: Column | str, low_words: Column | None = None) -> Column:
    """Emphasis: repeated words, repeated characters, spaced letters (F5). ``low_words``: the words in lower case, where they are known."""
    text = col(text)

    def repeats(words: Column) -> Column:
        # the next word by index: linear in the message length
        return F.size(
            F.filter(words, lambda w, i: (F.length(w) > 2) & (w == F.get(words, i + 1)))
        )

    middle = rf"\s{WORD_CHARS}\s"
    spaced = rf"(?<!{WORD_CHARS}){WORD_CHARS}\s+{WORD_CHARS}\s+{WORD_CHARS}(?!{WORD_CHARS})"
    counts = {
        "words": let(whitespace_words(F.lower(text)) if low_words is None else low_words, repeats),
        "chars": count(text, r"([^\n])\1{3,}"),
        "spaced": F.when(has(text, middle), has(text, spaced)).otherwise(False),
    }

    def body(c: Column) -> Column:
        return _feature(
            [
                [(c["words"] > 1, 0.1, "word_repetition")],
                [(c["chars"] > 2, 0.15, "excessive_character_repetition"), (c["chars"] > 0, 0.05, "character_repetition")],
                [(c["spaced"], 0.1, "spaced_emphasis")],
            ],
            word_repetition=c["words"], char_repetition=c["chars"],
        )

    return _counted(counts, body)


def structure_features(text: Column | str, n_words: Column | None = None) -> Column:
    """Structure: short shouted messages, fragments, selective capitals."""
    text = col(text)
    words = whitespace_words(text)
    n_words = F.size(words) if n_words is None else n_words
    shout = F.exists(words, lambda w: (F.upper(w) == w) & (F.length(w) > 2))
    fragments = lambda parts: (F.size(parts) > 3) & F.forall(parts, lambda s: count(s, NOT_SPACE + "+") <= 2)
    caps = count(text, rf"(?<!{WORD_CHARS})[A-Z]{{3,}}(?!{WORD_CHARS})")
    counts = {
        "n": n_words,
        "shout": F.when(n_words <= 3, shout).otherwise(False),
        "fragments": let(sentences(text), fragments),
        "caps": F.when(has(text, "[A-Z]{3}"), caps).otherwise(0),
    }

    def body(c: Column) -> Column:
        ratio = F.try_divide(c["caps"], c["n"])
        return _feature(
            [
                [(c["shout"], 0.1, "short_caps_message")],
                [(c["fragments"], 0.05, "fragmented_aggressive_structure")],
                [((c["caps"] > 0) & (c["caps"] < c["n"]) & ratio.between(0.2, 0.6), 0.1, "selective_caps_emphasis")],
            ],
            word_count=c["n"], caps_words=c["caps"],
        )

    return _counted(counts, body)


def context_score(features: list[Column]) -> Column:
    """Capped sum of feature scores with all indicators in order."""
    return F.struct(
        F.least(_sum(*[f["score"] for f in features]), F.lit(1.0)).alias("score"),
        F.concat(*[f["indicators"] for f in features]).alias("indicators"),
    )


# what a match of each intent rule contains: one text of every group
INTENT_NEEDLES = [
    [["you"], ["kill", "hurt", "harm", "destroy", "end"]], [["will"], ["hurt", "kill", "destroy"]], [["watch"], ["out"]],
    [["you"], ["are"], ["stupid", "ugly", "worthless", "pathetic"]], [["such"], ["loser", "idiot", "freak"]], [["hate"], ["you"]], [["hate"], ["you"]],
    [["nobody"], ["you"], ["likes", "wants", "cares"]], [["belong"], ["don't"], ["you"]],
]


def intent_scores(text: Column | str, low: Column | None = None) -> Column:
    """Struct of the five intent scores."""
    low = F.lower(col(text)) if low is None else low
    scores = {name: F.lit(0.0) for name in rules.INTENT_ORDER}
    for (intent, pattern, weight), groups in zip(rules.INTENT_RULES, INTENT_NEEDLES, strict=True):
        found = has(low, pattern)
        for needles in reversed(groups):
            found = guarded(low, needles, found, F.lit(False))
        scores[intent] = scores[intent] + F.when(found, F.lit(weight)).otherwise(F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in scores.items()])


def max_intent(intent: Column) -> Column:
    return F.greatest(*[intent[name] for name in rules.INTENT_ORDER])


def dominant_intent(intent: Column) -> Column:
    """First intent, in fixed order, that holds the maximum."""
    top = max_intent(intent)
    out = F.lit(rules.INTENT_ORDER[-1])
    for name in reversed(rules.INTENT_ORDER[:-1]):
        out = F.when(intent[name] == top, name).otherwise(out)
    return out


def context_config(text: Column | str, tokens: Column) -> Column:
    """Aggression, targeting and command scores by the configured rules (F8)."""
    text = col(text)
    caps = F.coalesce(F.try_divide(count_chars(text, r"\p{Lu}"), F.length(text)), F.lit(0.0))
    rules_hit = [(has(text, p), w, n) for n, p, w in rules.CONTEXT_PUNCTUATION]
    rules_hit += [(caps >= low, w, n) for n, low, w in rules.CONTEXT_CAPS]
    aggression = _sum(*[F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w, _ in rules_hit])
    pronouns = F.size(F.filter(tokens, lambda t: t.isin(rules.CONTEXT_PRONOUNS)))
    targeting = F.when(pronouns >= rules.CONTEXT_PRONOUN_MIN, F.lit(rules.CONTEXT_PRONOUN_WEIGHT)).otherwise(F.lit(0.0))
    groups = [
        (F.arrays_overlap(tokens, F.array(*map(F.lit, words))), w) for words, w in rules.CONTEXT_COMMANDS
    ]
    command = _sum(*[F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in groups])
    names = [F.when(c, n) for c, _, n in rules_hit]
    names += [F.when(targeting > 0, "personal_targeting")]
    names += [F.when(c, "command_structure") for c, _ in groups]
    return F.struct(
        aggression.alias("aggression"), targeting.alias("targeting"), command.alias("command"),
        F.array_compact(F.array(*names)).alias("indicators"),
    )

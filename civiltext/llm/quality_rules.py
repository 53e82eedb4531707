"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.functions.staging import computed

# Frequent function words of the four languages.
STOP_WORDS = [
    "the", "and", "of", "to", "in", "is", "that", "was", "for", "with", "on", "as", "at", "be", "this", "from", "are", "it", "by", "an",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "est", "que", "qui", "dans", "pour", "par", "sur", "pas", "avec", "ce",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "ist", "im", "nicht", "ein", "eine", "als", "auch", "auf", "für", "dem", "des",
    "el", "los", "las", "que", "y", "del", "se", "por", "con", "una", "su", "al", "lo", "como", "más", "pero", "sus", "ha", "o", "no",
]

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WORD_GAP = "[ \\x09-\\x0D]+"


def stop_word_count(text: Column) -> Column:
    """How many of the runs of letters and digits are stop words, in any case."""
    runs = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.size(F.filter(runs, lambda x: x.isin(*dict.fromkeys(STOP_WORDS))))


def char_count(text: Column, chars: str) -> Column:
    """How many of the text's characters are among ``chars``."""
    return F.regexp_count(text, F.lit("[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"))


@dataclass(frozen=True)
class Rule:
    """``times * measure`` compared with ``limit * base``: keeps the text if it holds.

    Whole numbers on both sides, so no ratio is ever divided or rounded; a base of ``one`` is 1.
    """

    name: str
    measure: str
    holds: str
    limit: int
    base: str = "one"
    times: int = 100


#: The contract's own two rules.
BASE_RULES = [
    Rule("words_min", "n_words", ">=", 50, times=1),
    Rule("repeated_words", "n_repeat_words", "<=", 50, "n_words"),
]

#: Length, symbol, stop-word and line rules. The limits are wide: ordinary prose stays far inside.
METHOD_RULES = [
    Rule("word_length_min", "word_chars", ">=", 200, "n_words"),
    Rule("word_length_max", "word_chars", "<=", 1500, "n_words"),
    Rule("symbols", "n_symbols", "<=", 30, "n_words"),
    Rule("stop_words", "n_stop_words", ">=", 2, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", "<=", 50, "n_lines"),
    Rule("letter_words", "n_letter_words", ">=", 60, "n_words"),
    Rule("capital_words", "n_capital_words", "<=", 60, "n_words"),
]

_HOLDS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}


def compiled(rules: list[Rule]) -> dict[str, Column]:
    """One boolean expression for each rule of a table."""
    base = lambda r: F.lit(1) if r.base == "one" else F.col(r.base)
    return {r.name: _HOLDS[r.holds](F.lit(r.times) * F.col(r.measure), F.lit(r.limit) * base(r)) for r in rules}


def all_hold(rules: list[Rule]) -> Column:
    return functools.reduce(operator.and_, compiled(rules).values(), F.lit(True))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of every whole text; row-local, no exchange, built-in functions only.
    A filter on the result stays above the measures, so they are computed once.

    A window of three words that is found again is seen by sorting the hashes of all windows of the
    text and comparing neighbours, so a long text costs n log n and not n squared.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    taken = set(docs.columns)
    name = lambda x: x if x not in taken else name(f"_{x}")
    w, win, pos, lines = map(name, ("_words", "_windows", "_positions", "_lines"))
    n = F.size(w)
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    near = lambda x, j: (F.get(win, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(win, j + 1)["h"].eqNullSafe(x["h"]))
    count = lambda kept: F.size(kept).cast("long")
    first = docs.withColumns(
        {
            w: F.filter(F.split(t, WORD_GAP), lambda x: x != ""),
            lines: F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit("[^ \\x09-\\x0D]"))),
        }
    )
    second = first.withColumns(
        {
            win: F.sort_array(
                F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
            )
        }
    )
    third = second.withColumns({pos: F.sort_array(F.transform(F.filter(win, near), lambda x: x["i"]))})
    gap = lambda p, k: F.least(F.lit(3), F.coalesce(F.get(pos, k + 1) - p, F.lit(3)))
    return computed(
        third,
        {
            "n_words": count(w),
            "word_chars": (F.length(t) - char_count(t, BLANKS)).cast("long"),
            "n_symbols": char_count(t, SYMBOLS).cast("long"),
            "n_lines": count(lines),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.aggregate(F.transform(pos, gap), F.lit(0), lambda a, b: a + b).cast("long"),
            "n_stop_words": stop_word_count(t).cast("long"),
            "n_letter_words": F.regexp_count(t, F.lit(r"(?<![^ \x09-\x0D])[^ \x09-\x0D\p{L}]*+\p{L}")).cast("long"),
            "n_capital_words": F.regexp_count(t, F.lit(r"(?<![^ \x09-\x0D])[^ \x09-\x0D\p{L}]*+\p{Lu}{2}")).cast("long"),
        },
        drop=(w, win, pos, lines),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words", "n_capital_words"]


def apply_rules(docs: DataFrame, text: str = "text", base: list[Rule] = BASE_RULES, rules: list[Rule] = METHOD_RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` (a rule of ``base`` doesn't hold) and ``kept``
    (every rule of both tables holds).

    A null text counts as one without words: it fails the base rules. Every row comes back once,
    repeated rows and null ids included. Columns of ``docs`` that have a measure's name are replaced
    by the measure.
    """
    clash = [c for c in docs.columns if c in {*MEASURES, "base_failed", "kept"}]
    measured = measures(docs.drop(*clash), text)
    return measured.withColumn("base_failed", ~all_hold(base)).withColumn("kept", ~F.col("base_failed") & all_hold(rules))

"""Gap-tolerant phrase matching inside one row.

``gap_regex`` expresses "words in order with at most ``max_gap`` words between
neighbours, each word taken at its nearest next place" as one regular
expression: a gap word may not equal the next phrase word, so the match never
backtracks and equals the greedy positional scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiltext.functions.staging import let
from civiltext.functions.text import NOT_WORD, WORD, WORD_CHARS, count
from civiltext.values import rules


MATCHES = "array<struct<start:int,end:int,gaps:int,strength:double>>"


def gap_regex(words: list[str], max_gap: int = 2) -> str:
    out = f"(?<!{WORD_CHARS}){re.escape(words[0])}(?!{WORD_CHARS})"
    for word in words[1:]:
        word = f"{re.escape(word)}(?!{WORD_CHARS})"
        out += f"{NOT_WORD}+(?:(?!{word}){WORD_CHARS}++{NOT_WORD}+){{0,{max_gap}}}{word}"
    return out


def gap_span(lower_text: Column, words: list[str], max_gap: int = 2) -> Column:
    """Token span of the first gapped match, NULL without a match.

    A cheap substring test on every word keeps the expression away from the
    texts that cannot match.
    """
    possible = F.lit(True)
    for word in sorted(set(words), key=len, reverse=True):
        possible = possible & F.contains(lower_text, F.lit(word))
    found = F.when(possible, F.regexp_extract(lower_text, gap_regex(words, max_gap), 0))
    return F.nullif(count(found, WORD), F.lit(0))


def word_importance(word: str, place: int, length: int) -> float:
    """Weight of one phrase word from its meaning, place and length."""
    score = 0.5
    score += 0.4 if word in rules.STRONG_WORDS else 0.2 if word in rules.ADDRESS_WORDS else 0.0
    edge = min(place, length - 1 - place)
    score += {0: 0.2, 1: 0.1}.get(edge, 0.0)
    score += -0.2 if len(word) <= 2 else 0.1 if len(word) >= 6 else 0.0
    return min(max(score, 0.1), 1.0)


def search_windows(words: list[str], bucket: str, base_gap: int = 2) -> list[int]:
    """Words allowed before each phrase word in a short, medium or long text."""
    n = len(words)
    scale = 1.0 if n <= 2 else 1.2 if n <= 4 else 1.5
    scale_text = {"short": 0.8, "medium": 1.0, "long": 1.2}[bucket]
    flexible = 1.3 if set(words) & set(rules.FLEXIBLE_WORDS) else 1.0
    limit = max(1, min(int(base_gap * scale * scale_text * flexible), 5))
    windows = []
    for place, word in enumerate(words):
        edge = 1.3 if place in (0, n - 1) else 1.0
        windows.append(max(1, min(int(limit * (0.5 + word_importance(word, place, n)) * edge), 8)))
    return windows


def adaptive_matches(tokens: Column, phrase: str, base_gap: int = 2, met: Column | None = None) -> Column:
    """All candidate matches of one phrase in a token array (M4).

    Returns ``array<struct<start,end,gaps,strength>>`` ordered by start. Each
    occurrence of the first word starts one candidate; later words are taken at
    their nearest place inside a window that depends on the text length. ``met``: those of the
    tokens that any phrase has, where they are known.
    """
    words = phrase.split()

    def lacks(t: Column) -> Column:
        out = F.lit(False)
        for word in dict.fromkeys(words):
            out = out | ~F.array_contains(t, F.lit(word))
        return out

    none = F.array().cast(MATCHES)
    if met is None:
        return let(tokens, lambda t: F.when(lacks(t), none).otherwise(_adaptive_matches(t, words, base_gap)))
    return F.when(lacks(met), none).otherwise(let(tokens, lambda t: _adaptive_matches(t, words, base_gap)))


def _adaptive_matches(tokens: Column, words: list[str], base_gap: int) -> Column:
    n = len(words)
    weights = [word_importance(w, i, n) for i, w in enumerate(words)]
    by_bucket = {b: search_windows(words, b, base_gap) for b in ("short", "medium", "long")}
    size = F.size(tokens)

    def window(place: int) -> Column:
        return (
            F.when(size < 10, by_bucket["short"][place])
            .when(size < 20, by_bucket["medium"][place])
            .otherwise(by_bucket["long"][place])
        )

    def penalty(gap: Column, weight: float) -> Column:
        raw = F.least(gap * F.lit(0.15), F.lit(0.6)) + F.lit((1.0 - weight) * 0.3)
        return F.when(gap == 0, F.lit(0.0)).otherwise(F.least(raw, F.lit(0.8)))

    starts = F.filter(F.transform(tokens, lambda t, i: F.when(t == words[0], i)), lambda p: p.isNotNull())
    state = F.transform(
        starts, lambda p: F.struct(p.alias("start"), p.alias("end"), F.lit(0).alias("gaps"), F.lit(0.0).alias("pen"))
    )
    def step_to(place: int):
        def step(s: Column) -> Column:
            offset = F.array_position(F.slice(tokens, s["end"] + 2, window(place) + 1), words[place]).cast("int")
            return F.when(
                offset > 0,
                F.struct(
                    s["start"].alias("start"),
                    (s["end"] + offset).alias("end"),
                    (s["gaps"] + offset - 1).alias("gaps"),
                    (s["pen"] + penalty(offset - 1, weights[place])).alias("pen"),
                ),
            )

        return step

    for place in range(1, n):
        state = F.filter(F.transform(state, step_to(place)), lambda s: s.isNotNull())

    importance = sum(weights) / n

    def finish(s: Column) -> Column:
        span = s["end"] - s["start"] + 1
        edge = F.least(s["start"] / size, (size - s["end"]) / size)
        strength = (
            F.lit(n) / span * 0.3
            + F.lit(importance * 0.25)
            + (F.lit(1.0) - s["pen"] / n) * 0.25
            + (F.lit(1.0) - edge * 0.1) * 0.2
            + F.lit(min(n * 0.05, 0.15))
        )
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["gaps"].alias("gaps"),
            F.greatest(F.lit(0.1), F.least(strength, F.lit(1.0))).alias("strength"),
        )

    return F.transform(state, finish)


def keep_strongest(matches: Column, threshold: float = 0.5) -> Column:
    """Drop matches that overlap a stronger kept one by more than ``threshold`` of the shorter (M5)."""
    def overlaps(a: Column, b: Column) -> Column:
        shared = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]) + 1
        shorter = F.least(a["end"] - a["start"], b["end"] - b["start"]) + 1
        return F.greatest(shared, F.lit(0)) / shorter > threshold

    def fold(island: Column) -> Column:
        ranked = F.array_sort(
            F.transform(island, lambda m: F.struct((-m["strength"]).alias("k"), m["start"].alias("s"), m.alias("m")))
        )
        return F.aggregate(
            F.transform(ranked, lambda r: r["m"]),
            F.array().cast(MATCHES),
            lambda acc, m: F.when(F.exists(acc, lambda k: overlaps(k, m)), acc).otherwise(F.array_append(acc, m)),
        )

    def split(ms: Column) -> Column:
        # candidates are ordered by start and by end, so a start beyond the previous end opens an island
        opens = F.filter(
            F.transform(ms, lambda m, i: F.when((i == 0) | (m["start"] > F.get(ms, i - 1)["end"]), i + 1)),
            lambda i: i.isNotNull(),
        )
        bounds = lambda ops: F.transform(
            ops, lambda b, i: F.slice(ms, b, F.coalesce(F.get(ops, i + 1), F.size(ms) + 1) - b)
        )
        return F.flatten(F.transform(let(opens, bounds), fold))

    return F.when(F.size(matches) > 1, let(F.array_sort(matches), split)).otherwise(matches)

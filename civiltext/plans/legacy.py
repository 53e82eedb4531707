"""The legacy scoring profile: words, substrings, patterns and intent keywords."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.functions.severity import sev_name, sev_rank, severity_of
from civiltext.functions.staging import computed, members
from civiltext.functions.text import has, is_blank, normalise, strip, strip_punct_tokens
from civiltext.values import terms

INTENT_FACTORS = {"low": 0.5, "medium": 1.0, "high": 1.5}


@dataclass
class LegacyRules:
    words: list[str] = field(default_factory=lambda: list(terms.LEGACY_WORDS))
    phrases: list[str] = field(default_factory=lambda: list(terms.LEGACY_PHRASES))
    severity: dict[str, str] = field(default_factory=lambda: dict(terms.LEGACY_SEVERITY))
    patterns: list[tuple[str, str]] = field(default_factory=list)  # (pattern, severity)
    intents: list[tuple[list[str], str]] = field(default_factory=list)  # (keywords, severity)


def intent_score(norm: Column, words: Column, intents: list[tuple[list[str], str]], cap: float = 0.5) -> Column:
    """0.1 per keyword that is a token or a substring, times its severity factor, capped (M7)."""
    total = F.lit(0.0)
    for keywords, level in intents:
        n = F.lit(0)
        for kw in keywords:
            hit = F.array_contains(words, kw.lower()) | F.contains(norm, F.lit(kw.lower()))
            n = n + F.when(hit, 1).otherwise(0)
        total = total + n * F.lit(0.1) * F.lit(INTENT_FACTORS.get(level, 1.0))
    return F.least(total, F.lit(cap))


def score_legacy(
    df: DataFrame, table: LegacyRules | None = None, details: bool = True, text: str = "text"
) -> DataFrame:
    """Adds found words, phrases and patterns, total_indicators, confidence, is_bullying, severity."""
    t = table or LegacyRules()
    out = df.withColumn("_norm", normalise(strip(F.coalesce(text, F.lit(""))), "legacy"))
    out = out.withColumn("_words", strip_punct_tokens("_norm"))
    norm, words = F.col("_norm"), F.col("_words")
    as_array = lambda items: F.array(*items).cast("array<string>")
    out = computed(
        out,
        {
            "found_words": members("_words", [x.lower() for x in t.words]),
            "found_phrases": F.array_compact(
                as_array([F.when(F.contains(norm, F.lit(p.lower())), p.lower()) for p in t.phrases])
            ),
            "found_patterns": F.array_compact(as_array([F.when(has(norm, "(?i)" + p), p) for p, _ in t.patterns])),
            "intent_score": intent_score(norm, words, t.intents),
            "word_count": F.size(words),
        },
        drop=("_norm", "_words"),
    )
    n_words, n_phrases, n_patterns = (F.size(c) for c in ("found_words", "found_phrases", "found_patterns"))
    pattern_levels = dict(t.patterns)
    ranks = F.concat(
        F.transform("found_words", lambda w: sev_rank(severity_of(w, t.severity, "medium"))),
        F.transform("found_phrases", lambda p: sev_rank(severity_of(p, t.severity, "high"))),
        F.transform("found_patterns", lambda p: sev_rank(severity_of(p, pattern_levels, "medium"))),
    )
    out = computed(
        out,
        {
            "total_indicators": n_words + n_phrases + n_patterns,
            "confidence": F.when(is_blank(text), 0.0).otherwise(
                F.least(n_words * 0.3 + n_phrases * 0.5 + n_patterns * 0.4 + F.col("intent_score"), F.lit(1.0))
            ),
            "_rank": F.coalesce(F.array_max(ranks), F.lit(0)),
        },
    )
    out = out.withColumn(
        "is_bullying", ~is_blank(text) & ((F.col("total_indicators") > 0) | (F.col("confidence") >= 0.3))
    )
    out = out.withColumn("severity", F.when(F.col("is_bullying"), sev_name(F.col("_rank"))).otherwise("none"))
    out = out.withColumn("detection_method", F.when(is_blank(text), "empty_text").otherwise("local_database"))
    out = out.drop("_rank")
    return out if details else out.drop("found_words", "found_phrases", "found_patterns", "total_indicators", "word_count")

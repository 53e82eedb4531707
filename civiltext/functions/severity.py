"""Severity ranks, look-ups and message templates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiltext.values import rules


def sev_rank(severity: Column) -> Column:
    """Ordinal of a severity name; unknown names rank 0."""
    rank = F.lit(0)
    for i, name in enumerate(rules.SEVERITIES):
        rank = F.when(severity == name, i).otherwise(rank) if i else rank
    return rank


def sev_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, rules.SEVERITIES)), (rank + 1).cast("int"))


def severity_of(term: Column, severities: dict[str, str], default: str) -> Column:
    """Look a term up in a small severity map; one IN list per level."""
    out = F.lit(default)
    for level in rules.SEVERITIES:
        terms = sorted(t for t, s in severities.items() if s == level)
        if terms and level != default:
            out = F.when(term.isin(terms), level).otherwise(out)
    return out


def severity_band(confidence: Column) -> Column:
    """Severity name of a confidence by the configured bands."""
    out = F.lit("none")
    for name, low in rules.SEVERITY_BANDS:
        out = F.when(confidence >= low, name).otherwise(out)
    return out


def reduce_short(confidence: Column, short: Column) -> Column:
    """The confidence of a text of one or two words, lowered where it is over one half."""
    return F.when(short & (confidence > 0.5), confidence * 0.8).otherwise(confidence)


def explain(flag: Column, severity: Column, confidence: Column, categories: Column, action: Column) -> Column:
    """Templated sentence for one result."""
    found = F.concat(
        F.lit("Cyberbullying detected with "), severity, F.lit(" severity ("),
        F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("% confidence)."),
        F.when(F.size(categories) > 0, F.concat(F.lit(" Detected categories: "), F.array_join(categories, ", "), F.lit("."))).otherwise(""),
        F.when(action == "block", " Immediate action recommended.")
        .when(action == "escalate", " Consider escalating to human moderator.")
        .otherwise(""),
    )
    return F.when(flag, found).otherwise(rules.SAFE_TEXT)

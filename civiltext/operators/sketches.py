"""Daily sketches of messages: small states that are stored once and merged for any span of days.

Distinct texts are kept as HyperLogLog states, frequent terms as frequent-item states. A report over many
days merges a state for each day and never reads the messages again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^14 registers: a relative standard error of about 0.8 %.
HLL_BITS = 14
HLL_ERROR = 1.04 / (1 << HLL_BITS // 2)
#: Items that a frequent-item state tracks; with no more different ones its counts are exact.
TRACKED = 10_000


def daily_texts(messages: DataFrame, ts: str = "ts", text: str = "text") -> DataFrame:
    """(day, n, texts): messages and the state of their distinct texts for each day; a null text is no text (Q10)."""
    return messages.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.col(text)).alias("n"), F.hll_sketch_agg(F.md5(text), HLL_BITS).alias("texts"))


def duplicate_report(days: DataFrame) -> DataFrame:
    """Messages, estimated distinct texts and share of repeats of the days together; one row."""
    merged = days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.hll_sketch_estimate(F.hll_union_agg("texts")).alias("distinct_texts"))
    distinct = F.least(F.coalesce("distinct_texts", F.lit(0)), F.col("n"))
    return merged.select("n", distinct.alias("distinct_texts"), F.coalesce(F.try_divide(F.col("n") - distinct, F.col("n")), F.lit(0.0)).alias("duplicate_share"))


def daily_terms(results: DataFrame, ts: str = "ts", tracked: int = TRACKED) -> DataFrame:
    """(day, terms): the state of the terms that matched on each day, patterns left out (Q4)."""
    found = results.select(F.to_date(ts).alias("day"), F.explode("detections").alias("d")).filter("d.type <> 'pattern'")
    return found.select("day", F.col("d.value").alias("term")).groupBy("day").agg(F.expr(f"approx_top_k_accumulate(term, {tracked})").alias("terms"))


def top_terms_of(days: DataFrame, k: int = 10, tracked: int = TRACKED) -> DataFrame:
    """(term, n): the ``k`` terms that matched most often on the days together, by falling count, then by term.

    More than ``k`` are asked of the merged state, so that terms of an equal count are ordered by name.
    """
    asked = min(tracked, max(100, 10 * k))
    merged = days.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(terms, {tracked}), {asked})").alias("top"))
    items = merged.select(F.inline("top")).toDF("term", "n")
    return items.orderBy(F.desc("n"), "term").limit(k)

"""Valence-table sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.operators.joins import lookup_join

ALPHA = 15.0  # normalisation constant of the published compound formula


def sentiment(toks: DataFrame, valence: DataFrame, key: str = "msg_id") -> DataFrame:
    """Compound, positive, neutral and negative shares per message that has tokens.

    The valence join is a broadcast for a small table, and the aggregate combines
    a message's tokens before the one shuffle.
    """
    scored = lookup_join(toks, valence, ["token"], "left")
    v = F.coalesce("valence", F.lit(0.0))
    sums = scored.groupBy(key).agg(
        F.sum(v).alias("_s"),
        F.sum(F.when(v > 0, v + 1.0).otherwise(0.0)).alias("_p"),
        F.sum(F.when(v < 0, v - 1.0).otherwise(0.0)).alias("_m"),
        F.count_if(v == 0).alias("_z"),
    )
    total = F.col("_p") - F.col("_m") + F.col("_z")
    return sums.select(
        key,
        (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + ALPHA)).alias("compound"),
        F.coalesce(F.try_divide(F.col("_p"), total), F.lit(0.0)).alias("pos"),
        F.coalesce(F.try_divide(-F.col("_m"), total), F.lit(0.0)).alias("neg"),
        F.coalesce(F.try_divide(F.col("_z"), total), F.lit(0.0)).alias("neu"),
    )

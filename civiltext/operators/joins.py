"""Joins that check the size of a side before broadcasting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 32


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large side with a look-up side (``inner``, ``left``, ``left_semi`` or ``left_anti``).

    A look-up side of a checked small size is broadcast and the large side never
    moves. A larger one is replicated once per salt and both sides are shuffled
    on (key, salt), so one hot key of the large side spreads over ``salts`` tasks.
    """
    if fits(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")

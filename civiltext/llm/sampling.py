"""Bounded samples for fitting: the rows with the smallest hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, hashed: list[Column], n: int) -> DataFrame:
    """The rows whose hash is among the n smallest; rows that are equal there come together.

    The n-th smallest hash is found first, so that only hashes and never texts are sorted.
    """
    h = F.xxhash64(*hashed)
    top = rows.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h").alias("top")).first()["top"]
    return rows.filter(h <= top) if top is not None else rows.limit(0)

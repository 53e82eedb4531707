"""An order-statistic index: the rows of a table numbered by a sort order, kept so that a page reads its range only.

One range exchange deals the rows out in order; inside a range the place of a row is its number in the
sorted task, so no window is needed. What has to be known besides is the number of rows of each range,
one short entry for about ``ROWS_PER_RANGE`` rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.sources.storage import scratch_path

ROWS_PER_RANGE = 1_000_000
#: Spark's running numbers have the task in the bits above these.
_INSIDE = (1 << 33) - 1


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


@dataclass(frozen=True)
class PageIndex:
    """``rows`` are stored by range, with the columns ``part`` (the range) and ``at`` (the place in it)."""

    rows: DataFrame
    part: str
    at: str
    sizes: list[tuple[int, int, int]]  # (range, rows before it, its rows)

    @property
    def total(self) -> int:
        return self.sizes[-1][1] + self.sizes[-1][2] if self.sizes else 0

    def numbered(self, name: str = "rn") -> DataFrame:
        """All rows with their number from 1."""
        return self._with_number(self.rows, self.sizes, name)

    def between(self, first: int, last: int, name: str = "rn") -> DataFrame:
        """The rows numbered ``first`` to ``last``, read from the ranges that hold them and no others."""
        touched = [s for s in self.sizes if s[1] < last and s[1] + s[2] >= first]
        if not touched:
            return self._with_number(self.rows.filter(F.lit(False)), [], name)
        rows = self.rows.filter(F.col(self.part).between(touched[0][0], touched[-1][0]))
        return self._with_number(rows, touched, name).filter(F.col(name).between(first, last))

    def page(self, page: int, size: int, name: str = "rn") -> DataFrame:
        """Page ``page`` (from 1) of ``size`` rows."""
        return self.between((page - 1) * size + 1, page * size, name)

    def pages(self, size: int) -> int:
        return math.ceil(self.total / size)

    def _with_number(self, rows: DataFrame, sizes: list[tuple[int, int, int]], name: str) -> DataFrame:
        before = free_name(rows.columns, "_before")
        offsets = rows.sparkSession.createDataFrame([(p, b) for p, b, _ in sizes], f"`{self.part}` int, `{before}` long")
        # one row for each range, so the broadcast is a millionth of the table
        joined = rows.join(F.broadcast(offsets), self.part)
        return joined.withColumn(name, F.col(before) + F.col(self.at) + 1).drop(before, self.part, self.at)


def page_index(df: DataFrame, order_by: list[str | Column], rows_per_range: int = ROWS_PER_RANGE, name: str = "page-index") -> PageIndex:
    """Index of ``df`` by ``order_by``; nulls come where the sort expressions put them (first by default).

    Rows that are equal in all of ``order_by`` get different numbers in any order, and may lie in
    several ranges, so a value that many rows share makes no large range. ``df`` is read three times
    (count, sampling of the ranges, exchange): pass a written table where computing it is dear.
    """
    part, at, tie = (free_name(df.columns, x) for x in ("_part", "_at", "_tie"))
    ranges = max(1, math.ceil(df.count() / rows_per_range))
    order = [F.col(c) if isinstance(c, str) else c for c in order_by] + [F.col(tie)]
    ranged = df.withColumn(tie, F.rand(7)).repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop(tie)
    placed = ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(_INSIDE)})
    path = scratch_path(df.sparkSession, name)
    placed.write.partitionBy(part).option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(placed.schema).parquet(path)
    sizes, before = [], 0
    for r in stored.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy(part).collect():  # one row for each range
        sizes.append((r[part], before, r["n"]))
        before += r["n"]
    return PageIndex(stored, part, at, sizes)

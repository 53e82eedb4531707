"""Sharding by histogram sort: equal bytes in every shard, found by counting, with one exchange of the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civiltext.operators.joins import lookup_join
from civiltext.sources.storage import materialise

#: Bits of the sort key that one round of probes tells apart: 4 096 probes for each open splitter.
PROBE_BITS = 12
KEY_BITS = 63
TOLERANCE = 0.01
#: Bytes that one ordering bucket should hold, and the bounds of the number of buckets as powers of two.
BUCKET_BYTES = 64 << 20
BUCKET_BITS = (10, 20)
#: A bucket with so many times the mean rows is cut further by the second key.
HOT_TIMES = 3
HOT_BITS = 10


@dataclass(frozen=True)
class Splitter:
    """Rows at or above (text_key, row_key) belong to the next shard; ``below`` is the exact bytes before it."""

    text_key: int
    row_key: int
    below: int


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8, none for null, plus 1."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def keys(text: Column, row_id: Column) -> tuple[Column, Column]:
    """The two parts of the sort key: one of the text, so that equal texts are neighbours, and one of the row."""
    half = lambda c: F.shiftrightunsigned(c, 1)
    return half(F.xxhash64(F.coalesce(text, F.lit("")))), half(F.xxhash64(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(1)))


def find_splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Splitter]:
    """Splitters of (k1, k2, size) rows, refined until each is within ``tolerance`` of its target.

    A round counts the exact bytes and rows of every probe interval that is still open, in one
    aggregation whose result has at most 4 096 rows for each splitter. A boundary inside the tolerance
    ends the search, first among the text keys (equal texts stay together), then, for a group of
    equal texts that is itself larger, among the row keys inside the group. The tolerance is a
    share of the mean shard; where a single row is larger than that, the nearer side of it is taken.
    """
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    mean = total / shards
    target = {s: round(total * s / shards) for s in range(1, shards)}
    # an open interval: (low, bits known of the 126, bytes below); all splitters start with the whole key space
    open_at = {s: (0, 0, 0) for s in target}
    done: dict[int, Splitter] = {}
    top = 2 * KEY_BITS
    at = lambda value: (value >> KEY_BITS, value & ((1 << KEY_BITS) - 1))
    while open_at and total:
        # one round looks at one part of the key only: bits stop at the end of the first part
        known = {bits for _, bits, _ in open_at.values()}
        histograms: dict[int, list[tuple[int, int, int]]] = {}
        for bits in known:
            step = min(PROBE_BITS, (KEY_BITS if bits < KEY_BITS else top) - bits)
            part, used = ("k1", bits) if bits < KEY_BITS else ("k2", bits - KEY_BITS)
            probe = F.shiftright(part, KEY_BITS - used - step).bitwiseAND((1 << step) - 1)
            lows = sorted({low for low, b, _ in open_at.values() if b == bits})
            inside = F.lit(False) if bits else F.lit(True)
            name = F.lit(0)
            for k, low in enumerate(lows if bits else []):
                k1, k2 = at(low)
                here = F.shiftright("k1", KEY_BITS - bits) == (k1 >> (KEY_BITS - bits)) if bits <= KEY_BITS else (F.col("k1") == k1) & (
                    F.shiftright("k2", top - bits) == (k2 >> (top - bits))
                )
                inside, name = inside | here, F.when(here, k).otherwise(name)
            counted = keyed.filter(inside).groupBy(name.alias("o"), probe.alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
            for r in counted.collect():
                histograms.setdefault(lows[r["o"]], []).append((r["p"], r["s"], r["n"]))
        following = {}
        for s, (low, bits, below) in open_at.items():
            step = min(PROBE_BITS, (KEY_BITS if bits < KEY_BITS else top) - bits)
            width = 1 << (top - bits - step)
            run = below
            for p, size, n in sorted(histograms[low]):
                if run + size >= target[s]:
                    start = low + p * width
                    near = min([(abs(run - target[s]), start, run), (abs(run + size - target[s]), start + width, run + size)])
                    if near[0] <= tolerance * mean or n == 1 or bits + step == top:
                        done[s] = Splitter(*at(near[1]), near[2])
                    else:
                        following[s] = (start, bits + step, run)
                    break
                run += size
        open_at = following
    return [done[s] for s in sorted(done)]


def shard_of(k1: Column, k2: Column, splitters: list[Splitter]) -> Column:
    """The number of splitters at or below a key."""
    out = F.lit(0)
    for x in splitters:
        out = out + ((k1 > x.text_key) | (k1 == x.text_key) & (k2 >= x.row_key)).cast("int")
    return out


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot: the sizes of the shards are near equal, slots gapless from 0.

    The sort key is (hash of the text, hash of the id). Splitters come from ``find_splitters``; then every
    row moves once, to its ordering bucket (shard, key interval), where it is numbered; the rows of the
    buckets before it, counted in the key table, are added. A bucket
    of one very frequent text is cut by the second key, so no task gets a whole hot group.

    A null text is empty (size 1). Null and repeated ids are rows like others; rows that are equal
    in all columns get different slots. With an empty table the result is empty. Columns of ``docs``
    with the names of the new ones are replaced.
    """
    new = ["size", "text_crc32", "shard", "slot"]
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    # the caller's row is one struct, so none of its names meets one of these
    packed = docs.select(F.struct(*keep).alias("row"), F.col(f"`{id_col}`").alias("id"), content.alias("content"))
    k1, k2 = keys(F.col("content"), F.col("id"))
    size = size_of(F.col("content"))
    keyed = materialise(packed.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")), "shard-keys")
    splitters = find_splitters(keyed, shards, tolerance)
    shard = shard_of(F.col("k1"), F.col("k2"), splitters)

    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    bits = min(BUCKET_BITS[1], max(BUCKET_BITS[0], math.ceil(math.log2(max(1, total["s"]) / BUCKET_BYTES + 1))))
    interval = F.shiftright("k1", KEY_BITS - bits)
    crowded = max(HOT_TIMES * max(1, total["n"] >> bits), 100)
    # at most a third of the buckets can be crowded
    hot = keyed.groupBy(interval.alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).select("b", F.lit(True).alias("hot"))
    hot = materialise(hot, "shard-crowded")

    def bucketed(rows: DataFrame) -> DataFrame:
        known = lookup_join(rows.withColumns({"shard": shard, "b": interval}), hot, ["b"], "left")
        return known.withColumn("f", F.when(F.col("hot"), F.shiftright("k2", KEY_BITS - HOT_BITS)).otherwise(F.lit(0)).cast("long")).drop("hot")

    counts = bucketed(keyed).groupBy("shard", "b", "f").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("b", "f").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "shard-starts")

    placed = packed.withColumns({"k1": k1, "k2": k2, "size": size, "text_crc32": F.crc32(F.encode("content", "UTF-8")).cast("long")}).drop("content")
    within = Window.partitionBy("shard", "b", "f").orderBy("k1", "k2", "id")
    numbered = bucketed(placed).withColumn("place", F.row_number().over(within).cast("long") - 1)
    out = lookup_join(numbered, starts, ["shard", "b", "f"], "left")
    return out.select("row.*", "size", "text_crc32", "shard", (F.col("place") + F.col("start")).alias("slot"))

"""Throttling: emit an event, then stay silent per key until ``ttl`` has passed since that emission.

The rule is sequential per key, but it is computed without gathering a key:

1. the events are cut into a time grid finer than ``ttl``; a small summary holds
   the first and last event of each (key, cell);
2. every event gets a pointer to the first event at least ``ttl`` later, found
   inside one grid cell or, failing that, from the summary;
3. events after a silence of ``ttl`` certainly emit; the rest of the emissions
   are reached from them by pointer doubling, in log2(chain length) joins.

All joins are on (key, time), so a hot key spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civiltext.sources.storage import materialise
from civiltext.values import rules

CELLS_PER_TTL = 16


def throttle(
    events: DataFrame, key: str, ts: str, ttl_s: int = rules.CACHE_TTL_SECONDS, event_id: str = "event_id",
    carry: DataFrame | None = None,
) -> DataFrame:
    """Emitted events as (key, ts, event_id).

    ``carry`` holds the last emission per key (key, ts) of an earlier run; those
    count as emitted but are not returned. No event may lie before the carried
    emission of its key: ``drain_throttle`` holds events back to see to that.
    """
    ttl = ttl_s * 1_000_000
    cell = max(ttl // CELLS_PER_TTL, 1)
    timed = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event_id).alias("id"))
    # equal times: only the lowest id can emit; combined before the shuffle
    ev = timed.groupBy(key, "t").agg(F.min("id").alias("id"))
    start = None
    if carry is not None:
        start = carry.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
        carried = start.select(key, F.col("t").alias("_c"))
        # an event within ttl of the carried emission is silent whatever follows
        ev = ev.join(carried, key, "left").filter("_c is null or t >= _c + %d" % ttl).drop("_c")
    ev = materialise(ev, "throttle-events")
    grid = lambda c: F.floor(c / cell).cast("bigint")
    cells = ev.groupBy(key, grid(F.col("t")).alias("cell")).agg(F.min("t").alias("first"), F.max("t").alias("last"))

    # next event at least ttl later: first inside the probe's cell ...
    here = ev.select(key, grid(F.col("t")).alias("cell"), F.col("t").alias("x"), F.col("t").alias("hit"), F.lit(None).cast("bigint").alias("src"))
    probe = F.col("t") + ttl
    probes = ev.select(key, grid(probe).alias("cell"), probe.alias("x"), F.lit(None).cast("bigint").alias("hit"), F.col("t").alias("src"))
    inside = W.partitionBy(key, "cell").orderBy(F.desc("x")).rangeBetween(W.unboundedPreceding, W.currentRow)
    found = here.unionByName(probes).withColumn("nxt", F.min("hit").over(inside)).filter("src is not null")
    # ... else the first event of the next cell that has one; one row per (key, cell) here
    later = W.partitionBy(key).orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
    wanted = found.filter("nxt is null").groupBy(key, "cell").agg(F.lit(None).cast("bigint").alias("first"))
    after = (
        cells.select(key, "cell", "first").unionByName(wanted)
        .groupBy(key, "cell").agg(F.min("first").alias("first"))
        .withColumn("beyond", F.min("first").over(later)).select(key, "cell", "beyond")
    )
    edges = found.join(after, [key, "cell"], "left").select(
        key, F.col("src").alias("t"), F.coalesce("nxt", "beyond").alias("nxt")
    ).filter("nxt is not null")

    # certain emissions: the first event of a cell after a silence of at least ttl
    order = W.partitionBy(key).orderBy("cell")
    gaps = cells.withColumn("prev", F.lag("last").over(order))
    roots = gaps.filter("prev is null or first - prev >= %d" % ttl).select(key, F.col("first").alias("t"))
    reach, jump = materialise(roots.distinct(), "throttle-reach"), materialise(edges, "throttle-jump")
    size = reach.count()
    while True:
        step = reach.join(jump, [key, "t"]).select(key, F.col("nxt").alias("t"))
        reach = materialise(reach.union(step).distinct(), "throttle-reach")
        grown = reach.count()
        if grown == size:
            break
        size = grown
        hop = jump.select(key, F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        jump = materialise(jump.join(hop, [key, "nxt"]).select(key, "t", F.col("far").alias("nxt")), "throttle-jump")
    out = ev.join(reach, [key, "t"])
    return out.select(key, F.timestamp_micros("t").alias(ts), F.col("id").alias(event_id))

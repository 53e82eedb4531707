"""Streaming operators that keep their state in the state store, or under the number of the micro-batch.

``throttle_stream``   keyed state with event-time timers; state goes when its time is over
``append_metrics``    windows that leave once the watermark has passed them, kept by day, dropped by day
``run_counters``      counts of each micro-batch under its number, so that a repeated one changes nothing
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from civiltext.operators.analytics import confidence_bucket
from civiltext.operators.throttle import throttle
from civiltext.sources.storage import discard, scratch_path
from civiltext.streaming.streams import WATERMARK, window_metrics
from civiltext.values import rules

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# -- throttle ------------------------------------------------------------------------------------


class Throttling(StatefulProcessor):
    """Events wait until the watermark has passed them; then, in their order, one emits if the last emission is ``ttl`` old."""

    def __init__(self, key: str, ts: str, event_id: str, ttl_us: int):
        self.names, self.ttl = (key, ts, event_id), ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, id long")
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for part in rows:
            if not len(part):  # a batch that brings timers alone
                continue
            found += zip(*(part.iloc[:, i].astype("int64").tolist() for i in (2, 3)))  # by place: aliases do not arrive
        if found:
            self.waiting.appendList(found)
            self.handle.registerTimer(-(-min(found)[0] // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(r[0]), int(r[1])) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        last = int(self.last.get()[0]) if self.last.exists() else None
        out = []
        for t, event in ready:
            if last is None or t - last >= self.ttl:
                out.append((key[0], t, event))
                last = t
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        if last is not None and last + self.ttl <= mark and not rest:
            self.last.clear()  # whatever comes later may emit at once
        elif last is not None and out:
            self.last.update((last,))
        if last is not None and not rest and last + self.ttl > mark:
            self.handle.registerTimer(-(-(last + self.ttl) // 1000))
        if out:
            yield pd.DataFrame(out, columns=["_key", "_t", "_id"])


def throttle_stream(
    stream: DataFrame, key: str, ts: str = "ts", ttl_s: int = rules.CACHE_TTL_SECONDS, event_id: str = "event_id", lateness: str = WATERMARK
) -> DataFrame:
    """Emitted events (key, ts, event_id) of a stream, in append mode (ST3).

    Equal to the batch throttle of all events that are not late, as far as the watermark has come.
    A key's state is what waits and one time; it goes when the time is over. Events of one key are
    handled in one task, in bounded pieces as they arrive; the batch operator spreads a hot key.
    """
    kind = stream.schema[key].dataType.simpleString()
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    slim = timed.select(F.col(key).alias("_key"), ts, F.unix_micros(ts).alias("_t"), F.col(event_id).cast("long").alias("_id"))
    out = slim.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=Throttling(key, ts, event_id, ttl_s * 1_000_000), outputStructType=f"_key {kind}, _t long, _id long",
        outputMode="Append", timeMode="EventTime",
    )
    return out.select(F.col("_key").alias(key), F.timestamp_micros("_t").alias(ts), F.col("_id").alias(event_id))


def throttle_rest(spark: SparkSession, checkpoint: str, key: str, ts: str = "ts", ttl_s: int = rules.CACHE_TTL_SECONDS, event_id: str = "event_id") -> DataFrame:
    """What a stopped ``throttle_stream`` still held, throttled as if nothing else came."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    at = lambda c: F.timestamp_micros(F.col(c)).alias(ts)
    waiting = read("waiting").select(F.col("key._key").alias(key), at("list_element.t"), F.col("list_element.id").alias(event_id))
    last = read("last").select(F.col("key._key").alias(key), at("value.t"))
    return throttle(waiting, key, ts, ttl_s, event_id, last)


def run_throttle_state(stream: DataFrame, key: str, ts: str = "ts", ttl_s: int = rules.CACHE_TTL_SECONDS, event_id: str = "event_id", lateness: str = WATERMARK, base: str | None = None) -> DataFrame:
    """Drains ``throttle_stream`` and adds what it still held. ``base`` continues from an earlier run's folder."""
    spark = stream.sparkSession
    base = base or scratch_path(spark, "throttle-state")
    drain(throttle_stream(stream, key, ts, ttl_s, event_id, lateness), f"{base}/out", f"{base}/checkpoint")
    emitted = spark.read.parquet(f"{base}/out")
    return emitted.unionByName(throttle_rest(spark, f"{base}/checkpoint", key, ts, ttl_s, event_id))


def drain(stream: DataFrame, out: str, checkpoint: str, by: tuple[str, ...] = ()) -> None:
    """Runs a stream over what is available, in append mode, with the state in RocksDB."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        (writer.partitionBy(*by) if by else writer).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


# -- metrics ---------------------------------------------------------------------------------------


def append_metrics(events: DataFrame, per: str = f"{rules.METRICS_SECONDS} seconds", ts: str = "ts") -> DataFrame:
    """``window_metrics`` with the window's day; in append mode a window leaves once, when the watermark has passed it,
    and its state with it, so the state holds the windows of the lateness alone (ST4)."""
    return window_metrics(events, per, ts).withColumn("day", F.to_date("window_start"))


def run_append_metrics(events: DataFrame, per: str, base: str | None = None, ts: str = "ts") -> tuple[DataFrame, str]:
    """(closed windows, the folder): drains a stream into a table by micro-batch and day; called again it goes on where it stopped.

    A micro-batch that is repeated replaces its own rows.
    """
    spark = events.sparkSession
    base = base or scratch_path(spark, "append-metrics")
    metrics = append_metrics(events, per, ts)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").partitionBy("day").parquet(f"{base}/metrics/batch={epoch}")

    query = (
        metrics.writeStream.outputMode("append").foreachBatch(save)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_metrics(spark, base, metrics.schema), base


def read_metrics(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """The stored windows; ``batch`` says which micro-batch closed them."""
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{base}/metrics")


def drop_days(metrics: DataFrame, base: str, days: int = 30) -> list[str]:
    """Retention: removes the folders of days that are ``days`` or more before the newest; no row is rewritten."""
    stored = [(str(r["day"]), r["batch"]) for r in metrics.select("day", "batch").distinct().collect()]  # folders, not rows
    newest = max((d for d, _ in stored), default=None)
    old = [(d, b) for d, b in stored if (pd.Timestamp(newest) - pd.Timestamp(d)).days >= days]
    for d, b in old:
        discard(metrics.sparkSession, f"{base}/metrics/batch={b}/day={d}")
    return sorted({d for d, _ in old})


# -- counters --------------------------------------------------------------------------------------


def counter_deltas(results: DataFrame) -> DataFrame:
    """(counter, name, bucket, n, flagged): messages by severity and confidence bucket, and by category where there are any (ST6)."""
    def row(counter: str, name: Column, bucket: Column) -> Column:
        return F.struct(F.lit(counter).alias("counter"), name.alias("name"), bucket.cast("int").alias("bucket"))

    # one pass: the messages are scored once for both counters
    rows = F.array(row("severity", F.col("severity"), confidence_bucket("confidence")))
    if "categories" in results.columns:
        names = F.array_distinct(F.transform("categories", lambda c: c["category"]))
        rows = F.concat(rows, F.coalesce(F.transform(names, lambda c: row("category", c, F.lit(None))), F.slice(rows, 1, 0)))
    flat = results.select("is_bullying", F.inline(rows))
    return flat.groupBy("counter", "name", "bucket").agg(F.count("*").alias("n"), F.count_if("is_bullying").alias("flagged"))


def save_deltas(batch: DataFrame, epoch: int, base: str) -> None:
    """Counts of one micro-batch under its number: a repeated one replaces its own counts by equal ones."""
    counter_deltas(batch).coalesce(1).write.mode("overwrite").parquet(f"{base}/deltas/epoch={epoch}")  # some dozen rows


DELTAS = "counter string, name string, bucket int, n long, flagged long"


def counters(spark: SparkSession, base: str) -> DataFrame:
    """The sums of all micro-batches."""
    kept = spark.read.schema(DELTAS).parquet(f"{base}/deltas")
    return kept.groupBy("counter", "name", "bucket").agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"))


def run_counters(results: DataFrame, base: str | None = None, save=save_deltas) -> tuple[DataFrame, str]:
    """(counters, the folder): drains scored messages; only a batch's own counts are computed and written."""
    spark = results.sparkSession
    base = base or scratch_path(spark, "counters")
    # a stream without rows has no micro-batch
    spark.createDataFrame([], DELTAS).write.mode("overwrite").parquet(f"{base}/deltas/epoch=-1")
    query = (
        results.writeStream.foreachBatch(lambda batch, epoch: save(batch, epoch, base))
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return counters(spark, base), base

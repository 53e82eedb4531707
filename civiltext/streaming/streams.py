"""Structured Streaming versions of scoring, limits, metrics and alerts.

Each operator takes a streaming or a static DataFrame; only the ``run_*`` helpers
start queries. Sinks and checkpoints live in the cluster's shared folder.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.operators.analytics import confidence_bucket
from civiltext.operators.throttle import throttle
from civiltext.plans.multilingual import score_multilingual
from civiltext.sources.storage import scratch_path
from civiltext.values import rules

WATERMARK = "1 hour"


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as TIMESTAMP with the watermark set (a no-op on static data)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, WATERMARK)


def score_stream(messages: DataFrame, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Score arriving messages; row-local, so append mode needs no state (ST1)."""
    return score_multilingual(messages, threshold=threshold, text=text)


def rate_limit(
    events: DataFrame, key: str, per: str = "1 minute", limit: int = rules.RATE_LIMIT, ts: str = "ts"
) -> DataFrame:
    """Windows in which a client sent more than ``limit`` requests (ST2)."""
    counts = timed(events, ts).groupBy(F.window(ts, per), key).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > limit).select(F.col("window.start").alias("window_start"), key, "n")


def burst_limit(
    events: DataFrame, key: str, per: str = "10 seconds", slide: str = "5 seconds", limit: int = rules.RATE_BURST,
    ts: str = "ts",
) -> DataFrame:
    """Sliding windows in which a client exceeded the burst limit (ST2)."""
    counts = timed(events, ts).groupBy(F.window(ts, per, slide), key).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > limit).select(F.col("window.start").alias("window_start"), key, "n")


def window_metrics(
    events: DataFrame, per: str = f"{rules.METRICS_SECONDS} seconds", ts: str = "ts"
) -> DataFrame:
    """Count, errors and mean latency per tumbling window (ST4)."""
    return timed(events, ts).groupBy(F.window(ts, per)).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.avg("value").alias("mean_latency"),
    ).select(F.col("window.start").alias("window_start"), "n", "errors", "mean_latency")


def alerts(metrics: DataFrame, max_errors: float = rules.ALERT_ERRORS, max_latency: float = rules.ALERT_LATENCY) -> DataFrame:
    """Windows with too many errors or too high a latency (ST5)."""
    many, slow = F.col("errors") > max_errors, F.col("mean_latency") > max_latency
    reason = F.concat_ws("+", F.when(many, "errors"), F.when(slow, "latency"))
    return metrics.filter(many | slow).withColumn("reason", reason)


def retain(metrics: DataFrame, days: int = 30) -> DataFrame:
    """Windows of the last ``days`` before the newest one (retention of ST4, batch only)."""
    newest = metrics.agg(F.max("window_start").alias("_newest"))
    # one row by construction
    out = metrics.join(F.broadcast(newest), F.col("window_start") > F.col("_newest") - F.make_dt_interval(days=F.lit(days)))
    return out.drop("_newest")


def running_stats(results: DataFrame) -> DataFrame:
    """Counters per severity and confidence bucket, updated per batch (ST6)."""
    return results.groupBy("severity", confidence_bucket("confidence").alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if("is_bullying").alias("flagged")
    )


def run_append(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Drain what is available into parquet and return the table."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", out + "-checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Drain an aggregate in complete mode; each batch replaces the table of the one before."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    latest = {"path": None}

    def save(batch: DataFrame, epoch: int) -> None:
        latest["path"] = f"{out}/epoch={epoch}"
        batch.write.mode("overwrite").parquet(latest["path"])

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(save)
        .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if latest["path"] is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(latest["path"])


def drain_throttle(
    stream: DataFrame, key: str, ts: str = "ts", ttl_s: int = rules.CACHE_TTL_SECONDS, event_id: str = "event_id",
    lateness: str = WATERMARK,
) -> tuple[DataFrame, DataFrame]:
    """Throttle a stream and drain it: (emitted events, late events), both as (key, ts, event_id) (ST3).

    Events are held until the watermark, the latest time of all batches less ``lateness``, has passed
    them, and then throttled from the last emission per key on; the rest follows at the end. The
    emissions are therefore those of the batch throttle over all events that are not late. Late is an
    event older than the watermark that the batches before its own have set: its neighbours are
    already out, so it takes no part and is returned in the second table.

    State is a set of tables per epoch in the shared folder, so a restarted batch reads the same
    state and overwrites its own output.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, "throttle-stream")
    slim = lambda df: df.select(key, F.col(ts).cast("timestamp").alias(ts), event_id)
    schema = slim(stream).schema
    last_schema = schema[:2]
    t = F.unix_micros(ts)
    done = {"epoch": None}

    def read(name: str, epoch: int) -> DataFrame:
        return spark.read.schema(last_schema if name == "last" else schema).parquet(f"{base}/{name}/epoch={epoch}")

    def write(df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{name}/epoch={epoch}")

    def emit(ready: DataFrame, epoch: int) -> None:
        carry = read("last", epoch - 1) if epoch else None
        write(throttle(ready, key, ts, ttl_s, event_id, carry), "out", epoch)
        mine = read("out", epoch).select(key, ts)
        known = mine if carry is None else carry.unionByName(mine)
        write(known.groupBy(key).agg(F.max(ts).alias(ts)), "last", epoch)

    def step(batch: DataFrame, epoch: int) -> None:
        write(slim(batch), "new", epoch)
        new = read("new", epoch)
        before = spark.read.parquet(f"{base}/mark/epoch={epoch - 1}").first()[0] if epoch else -(2**63)
        peak = new.agg(F.unix_micros(F.max(ts) - F.expr(f"INTERVAL {lateness}"))).first()[0]
        mark = before if peak is None else max(before, peak)
        write(spark.createDataFrame([(mark,)], "mark long"), "mark", epoch)
        write(new.filter(t < before), "late", epoch)
        held = new.filter(t >= before)
        held = held.unionByName(read("held", epoch - 1)) if epoch else held
        write(held.filter(t >= mark), "held", epoch)
        emit(held.filter(t < mark), epoch)
        done["epoch"] = epoch

    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if done["epoch"] is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], schema)
    emit(read("held", done["epoch"]), done["epoch"] + 1)
    whole = lambda name: spark.read.schema(schema).parquet(f"{base}/{name}").select(key, ts, event_id)
    return whole("out"), whole("late")


def run_throttle(
    stream: DataFrame, key: str, ts: str = "ts", ttl_s: int = rules.CACHE_TTL_SECONDS, event_id: str = "event_id",
    lateness: str = WATERMARK,
) -> DataFrame:
    """The emitted events of ``drain_throttle``; warns with their number when there are late ones."""
    emitted, late = drain_throttle(stream, key, ts, ttl_s, event_id, lateness)
    n = late.count()
    if n:
        warnings.warn(f"{n} events came more than {lateness} late and took no part; drain_throttle returns them", stacklevel=2)
    return emitted


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder as a stream, be it a single file or a folder of part files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a stream takes a single file by a pattern only
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")

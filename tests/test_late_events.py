"""The stream throttle gives the emissions of the batch throttle for events that arrive out of order."""

import random

import pytest
from pyspark.sql import functions as F

from civiltext.operators.throttle import throttle
from civiltext.streaming import streams

SCHEMA = "k string, s long, event_id long"


def stream_of(spark, folder, batches):
    for rows in batches:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.parquet(folder)


def ids(df):
    return sorted(r.event_id for r in df.collect())


def test_events_out_of_order_are_throttled_like_a_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("pq"), s, s) for s in rng.sample(range(20_000), 300)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randint(0, 3500))
    stream, table = stream_of(spark, str(tmp_path / "ev"), [arrival[i : i + 75] for i in range(0, 300, 75)])
    emitted, late = streams.drain_throttle(stream, "k", "ts", 700)
    assert ids(emitted) == ids(throttle(table, "k", "ts", 700)) and ids(late) == []


def test_an_event_far_before_the_last_emission_is_kept_or_returned_as_late(spark, tmp_path):
    stream, table = stream_of(spark, str(tmp_path / "ev"), [[("k", 100_000, 1)], [("k", 0, 2)]])
    assert ids(streams.run_throttle(stream, "k", lateness="2 days")) == ids(throttle(table, "k", "ts")) == [1, 2]
    emitted, late = streams.drain_throttle(stream, "k")
    assert ids(emitted) == [1] and ids(late) == [2]
    with pytest.warns(UserWarning, match="1 events"):
        streams.run_throttle(stream, "k")

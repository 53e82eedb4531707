"""Token bucket, throttle in the state store, appended metrics and counters: against plain or batch versions, after restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from civiltext.operators.throttle import throttle
from civiltext.operators.token_bucket import token_bucket
from civiltext.streaming import stateful
from civiltext.streaming.streams import stream_table, window_metrics

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, k string, event_type string, value double"


def event(i, seconds, k="a", kind="view"):
    return i, START + dt.timedelta(seconds=seconds), k, kind, float(i % 7)


def files(spark, folder, batches):
    """One file for each batch, taken one after the other."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


# -- token bucket -------------------------------------------------------------------------------------


def plain_bucket(rows, capacity, refill, per):
    out, state = {}, {}
    for i, ts, k, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        t = (ts - START) / dt.timedelta(microseconds=1)
        level, last = state.get(k, (float(capacity), t))
        level = min(capacity, level + (t - last) * refill / per / 1e6)
        out[i] = (round(level, 6), level < 1 - 1e-9)
        state[k] = (max(0.0, level - 1), t)
    return out


@pytest.mark.parametrize("piece", [7, 50_000])
def test_bucket_equals_a_sequential_one_on_a_hot_client(spark, piece):
    rng = random.Random(piece)
    rows = [event(i, rng.choice([rng.uniform(0, 900), 100.0, 200.5]), "hot" if i % 3 else rng.choice(["b", "c", None])) for i in range(600)]
    got = token_bucket(spark.createDataFrame(rows, SCHEMA), "k", "ts", "event_id", 5, 2, 3, piece=piece).collect()
    assert {r["event_id"]: (round(r["tokens"], 6), r["over"]) for r in got} == plain_bucket(rows, 5, 2, 3)
    assert sum(r["over"] for r in got) > 20


def test_bucket_without_events(spark):
    assert token_bucket(spark.createDataFrame([], SCHEMA), "k", "ts", "event_id", 3).collect() == []
    one = spark.createDataFrame([event(1, 5), (2, None, "a", "view", 0.0)], SCHEMA)
    assert [(r["event_id"], r["tokens"], r["over"]) for r in token_bucket(one, "k", "ts", "event_id", 3).collect()] == [(1, 3.0, False)]


# -- throttle -----------------------------------------------------------------------------------------


def test_throttle_out_of_order_over_a_restart_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [event(i, rng.uniform(0, 40_000), rng.choice("abc")) for i in range(300)]
    rows.sort(key=lambda r: r[1])
    blocks = [rows[i : i + 50] for i in range(0, 300, 50)]
    for b in blocks:
        rng.shuffle(b)
    # neighbours swap some events, all within the lateness
    blocks[1][0], blocks[2][0] = blocks[2][0], blocks[1][0]
    base = str(tmp_path / "state")
    source = files(spark, tmp_path / "in", blocks[:3])
    first = stateful.run_throttle_state(source(), "k", ttl_s=1200, lateness="5 hours", base=base)
    want = lambda some: sorted((r["k"], r["event_id"]) for r in throttle(spark.createDataFrame(some, SCHEMA), "k", "ts", 1200).collect())
    got = lambda df: sorted((r["k"], r["event_id"]) for r in df.collect())
    assert got(first) == want([e for b in blocks[:3] for e in b])
    files(spark, tmp_path / "in", blocks[3:])  # more arrives, a new query goes on from the checkpoint
    assert got(stateful.run_throttle_state(source(), "k", ttl_s=1200, lateness="5 hours", base=base)) == want(rows)


def test_throttle_state_expires(spark, tmp_path):
    blocks = [[event(1, 0, "a"), event(2, 10, "b")], [event(3, 50_000, "c")], [event(4, 100_000, "c")]]
    base = str(tmp_path / "state")
    stateful.run_throttle_state(files(spark, tmp_path / "in", blocks)(), "k", ttl_s=600, lateness="1 minute", base=base)
    for name in ("last", "waiting"):
        kept = spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", name).load()
        assert {r["key"]["_key"] for r in kept.collect()} <= {"c"}


# -- metrics and counters -------------------------------------------------------------------------------


def test_append_metrics_over_late_batches_and_retention(spark, tmp_path):
    rng = random.Random(5)
    rows = [event(i, 86_400 * (i // 100) + rng.uniform(0, 80_000), kind=rng.choice(["view", "error"])) for i in range(500)]
    rows.sort(key=lambda r: r[1])
    blocks = [rows[i : i + 125] for i in range(0, 500, 125)]
    blocks[0][-1], blocks[1][0] = blocks[1][0], blocks[0][-1]
    source = files(spark, tmp_path / "in", blocks[:2])
    base = str(tmp_path / "metrics")
    stateful.run_append_metrics(source(), "1 hour", base)
    files(spark, tmp_path / "in", blocks[2:])
    closed, _ = stateful.run_append_metrics(source(), "1 hour", base)
    # the watermark is an hour behind, and a row below it is late
    mark = max(r[1] for r in rows) - dt.timedelta(hours=1)
    batch = window_metrics(spark.createDataFrame(rows, SCHEMA), "1 hour").filter(F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(mark))
    cols = ["window_start", "n", "errors", F.round("mean_latency", 6)]
    got = sorted(map(tuple, closed.select(*cols).collect()))
    assert got == sorted(map(tuple, batch.select(*cols).collect())) and len(got) > 50
    dropped = stateful.drop_days(closed, base, 2)
    left = spark.read.schema(closed.schema).parquet(f"{base}/metrics")  # listed anew
    assert len(dropped) >= 2 and left.agg(F.countDistinct("day")).first()[0] == 2


RESULTS = "text string, severity string, confidence double, is_bullying boolean, categories array<struct<category:string,score:double>>"


def test_counters_survive_a_failed_and_repeated_batch(spark, tmp_path):
    rows = [("t", s, c, f, [(n, 0.5) for n in names]) for s, c, f, names in (("none", 0.0, False, []), ("high", 0.85, True, ["threats", "threats"]), ("low", 0.31, True, ["insults", "threats"]))]
    for _ in range(3):
        spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base, failed = str(tmp_path / "counters"), []

    def fails_once(batch, epoch, folder):
        stateful.save_deltas(batch, epoch, folder)
        if epoch == 1 and not failed:
            failed.append(epoch)
            raise RuntimeError("lost after its counts were written")

    with pytest.raises(Exception, match="lost after"):
        stateful.run_counters(source(), base, fails_once)
    got, _ = stateful.run_counters(source(), base, fails_once)
    found = {(r["counter"], r["name"], r["bucket"]): (r["n"], r["flagged"]) for r in got.collect()}
    assert found == {
        ("severity", "none", 0): (3, 0), ("severity", "high", 80): (3, 3), ("severity", "low", 30): (3, 3),
        ("category", "threats", None): (6, 6), ("category", "insults", None): (3, 3),
    }


def test_counters_of_a_table_in_one_file_in_parts_and_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([("t", "low", 0.31, True, [("insults", 0.5)])] * 6, RESULTS)
    parts = tmp_path / "parts" / "results.parquet"
    rows.repartition(3).write.parquet(str(parts))
    (tmp_path / "file").mkdir()
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file" / "results.parquet")
    for folder in ("parts", "file"):
        got, _ = stateful.run_counters(stream_table(spark, str(tmp_path / folder), "results"), str(tmp_path / f"counters-{folder}"))
        assert {(r["counter"], r["name"]): r["n"] for r in got.collect()} == {("severity", "low"): 6, ("category", "insults"): 6}
    (tmp_path / "empty").mkdir()
    none, _ = stateful.run_counters(spark.readStream.schema(RESULTS).parquet(str(tmp_path / "empty")), str(tmp_path / "counters-empty"))
    assert none.count() == 0

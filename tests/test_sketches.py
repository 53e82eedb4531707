"""Daily sketches: merged over days, against the exact operators."""

import random

from pyspark.sql import functions as F

from civiltext.operators import analytics, sketches


def test_merged_days_are_within_the_error_and_read_no_messages(spark, tmp_path):
    days = spark.range(40_000).select(
        F.expr("timestampadd(HOUR, cast(id % 240 AS int), TIMESTAMP '2024-01-01')").alias("ts"), F.when(F.col("id") % 100 != 0, (F.col("id") % 17_000).cast("string")).alias("text")
    )
    sketches.daily_texts(days).write.parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    assert stored.count() == 10
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-03", "2024-01-05")):
        got = sketches.duplicate_report(stored.filter(F.col("day").between(first, last))).first()
        exact = days.filter(F.to_date("ts").between(first, last) & F.col("text").isNotNull()).agg(F.count("*").alias("n"), F.countDistinct("text").alias("d")).first()
        assert got["n"] == exact["n"] and abs(got["distinct_texts"] - exact["d"]) <= 4 * sketches.HLL_ERROR * exact["d"]
        assert abs(got["duplicate_share"] - (1 - exact["d"] / exact["n"])) < 0.05
    none = sketches.duplicate_report(stored.limit(0)).first()
    assert tuple(none) == (0, 0, 0.0)


def test_top_terms_of_days(spark):
    rng = random.Random(1)
    rows = [(f"2024-01-0{rng.randint(1, 5)} 10:00:00", [(rng.choice(["single_word", "pattern"]), f"t{min(30, int(rng.expovariate(0.2)))}") for _ in range(rng.randint(0, 5))]) for _ in range(500)]
    results = spark.createDataFrame(rows, "ts string, detections array<struct<type:string,value:string>>")
    exact = [tuple(r) for r in analytics.top_terms(results, 8).collect()]
    assert [tuple(r) for r in sketches.top_terms_of(sketches.daily_terms(results), 8).collect()] == exact
    # fewer counters than terms: the frequent ones stay, counts are off by no more than the state says
    rough = {r["term"]: r["n"] for r in sketches.top_terms_of(sketches.daily_terms(results, tracked=25), 3, 25).collect()}
    assert rough and set(rough) & {t for t, _ in exact[:4]}

"""The order-statistic index: numbers, pages, nulls, repeated keys, clashing names, and what a page reads."""

import random

import pytest
from pyspark.sql import functions as F

from civiltext.operators.ordered import page_index


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    keys = [None] * 5 + [3] * 400 + rng.choices(range(1000), k=800)
    rng.shuffle(keys)
    return [(k, i, f"p{i}", 0) for i, k in enumerate(keys)]


def test_numbers_follow_the_order_and_one_key_may_fill_several_ranges(spark, rows):
    df = spark.createDataFrame(rows, "k int, i int, _part string, _AT int")
    index = page_index(df, ["k"], rows_per_range=50)
    got = sorted(index.numbered().collect(), key=lambda r: r["rn"])
    assert [r["rn"] for r in got] == list(range(1, len(rows) + 1))
    assert [r["k"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert sorted((r["k"], r["i"], r["_part"], r["_AT"]) for r in got if r["k"] is not None) == sorted(r for r in rows if r[0] is not None)
    assert max(n for _, _, n in index.sizes) < 200


def test_pages_are_slices_and_read_their_ranges_only(spark, rows):
    df = spark.createDataFrame(rows, "k int, i int, _part string, _AT int").select("k", "i")
    index = page_index(df, [F.desc_nulls_last("k"), "i"], rows_per_range=50)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert index.total == len(rows) and index.pages(70) == -(-len(rows) // 70)
    for page in (1, 2, 9, index.pages(70), index.pages(70) + 1):
        got = sorted(index.page(page, 70).collect(), key=lambda r: r["rn"])
        assert [(r["k"], r["i"]) for r in got] == [r[:2] for r in want[70 * (page - 1) : 70 * page]]
    plan = index.page(9, 70)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "Exchange hashpartitioning" not in plan


def test_empty_table(spark):
    index = page_index(spark.createDataFrame([], "k int"), ["k"])
    assert index.total == 0 and index.numbered().count() == 0 and index.page(1, 10).count() == 0

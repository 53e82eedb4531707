"""Every internal name as a caller's column, and ids of all types."""

import datetime
import decimal

import pytest

from civiltext.llm import decontam, neardup, shards

WORDS = "one two three four five six seven eight nine ten eleven twelve"
CLASH = ["n_shingles", "_kept", "_key", "_n", "key", "row", "of", "n", "h", "cls", "k1", "k2", "b", "f", "_b", "_f", "_id", "_row", "_start", "start", "place", "hot", "content", "id", "text2", "a b", "Item", "distance"]


def table(spark, rows, name):
    return spark.createDataFrame([(*r, f"v{i}") for i, r in enumerate(rows)], f"doc_id int, text string, `{name}` string")


@pytest.mark.parametrize("some", [CLASH[:10], CLASH[10:20], CLASH[20:]])
def test_columns_of_any_name_come_back_as_they_are(spark, some):
    rows = [(1, WORDS), (2, WORDS), (3, None), (3, None), (4, ""), (None, "alone here"), (None, "alone here"), (5, "what is the capital of the old kingdom of numbers and who told you so")]
    columns = ", ".join(f"`{c}` string" for c in some)
    df = spark.createDataFrame([(*r, *[f"{c}{i}" for c in some]) for i, r in enumerate(rows)], f"doc_id int, text string, {columns}")
    want = {r["doc_id"]: r for r in df.collect()}
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "3", "4", "5", "None"]
    assert want[1] in got and want[5] in got
    placed = shards.assign_shards(df, 2)
    assert placed.columns == [*df.columns, "size", "text_crc32", "shard", "slot"]
    assert sorted(map(str, placed.select(*[f"`{c}`" for c in df.columns]).collect())) == sorted(map(str, df.collect()))
    items = spark.createDataFrame([(1, "the capital of the old kingdom of numbers", "x")], "item_id int, text string, distance string")
    left = decontam.without_contaminated(df, items)
    assert left.columns == df.columns and left.count() == len(rows) - 1


@pytest.mark.parametrize(
    "kind,value",
    [("tinyint", 7), ("smallint", 7), ("int", 7), ("bigint", 7), ("decimal(10,2)", decimal.Decimal("7.50")), ("string", "x"), ("binary", bytearray(b"x")), ("double", 7.5), ("date", datetime.date(2024, 1, 1))],
)
def test_ids_of_any_type(spark, kind, value):
    items = spark.createDataFrame([(value, "the capital of the old kingdom of numbers"), (None, "who told you so"), (value, "cat")], f"item_id {kind}, text string")
    docs = spark.createDataFrame([(value, "what is the capital of the old kingdom of numbers and who told you so"), (None, "it concatenates"), (value, "a cat")], f"doc_id {kind}, text string")
    got = decontam.contaminations(docs, items)
    assert got.schema["item_id"].dataType.simpleString() == kind
    value = bytes(value) if kind == "binary" else value
    found = sorted((str(r["doc_id"]), str(r["item_id"]), r["distance"]) for r in got.collect())
    assert found == sorted([(str(value), str(value), 0), (str(value), "None", 0), (str(value), str(value), 0)])
    assert neardup.keep_one(docs).count() == 3 and shards.assign_shards(docs, 2).count() == 3


def test_one_repeated_row_moves_once(spark):
    df = spark.createDataFrame([(1, WORDS)] * 300 + [(2, "other words entirely")], "doc_id int, text string")
    kept = neardup.keep_one(df)
    assert kept.count() == 2
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()

"""Committed snapshots with two writers, deep pages, verdicts followed to the explanation."""

import threading

import pytest
from pyspark.sql import functions as F

from civiltext.operators import analytics
from civiltext.plans.category import score_category
from civiltext.plans.ensemble import ensemble, parse_verdicts
from civiltext.sources import writers

LEX = "term string, kind string, version int"


def test_two_writers_give_two_versions(spark, tmp_path):
    path, made, errors = str(tmp_path / "terms"), [], []

    def write(name):
        try:
            made.append((writers.write_snapshot(spark.createDataFrame([(name, "word", 1)] * 3, LEX), path), name))
        except Exception as e:  # noqa: BLE001 - shown below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b", "c")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(v for v, _ in made) == [1, 2, 3] == list(range(1, writers.latest_version(spark, path) + 1))
    for version, name in made:
        rows = writers.read_snapshot(spark, path, version).collect()
        assert {(r["term"], r["version"]) for r in rows} == {(name, version)} and len(rows) == 3


def test_a_stale_writer_is_refused_and_an_unfinished_manifest_is_no_version(spark, tmp_path):
    path = str(tmp_path / "terms")
    lex = spark.createDataFrame([("x", "word", 1)], LEX)
    assert writers.latest_version(spark, path) == 0
    assert writers.write_snapshot(lex, path, expected=0) == 1
    with pytest.raises(writers.SnapshotConflict):
        writers.write_snapshot(lex, path, expected=0)
    (tmp_path / "terms/versions/0000000002.txt").write_text("")  # its writer died after the claim
    assert writers.latest_version(spark, path) == 1
    assert writers.write_snapshot(lex, path) == 3 and writers.latest_version(spark, path) == 3


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    df = spark.range(1000).select(F.when(F.col("id") % 50 != 0, F.col("id") % 7).alias("k"), "id")
    for page in (1, 7, 20, 21):
        shallow = [tuple(r) for r in analytics.paginate(df, ["k", "id"], page, 50).orderBy("k", "id").collect()]
        monkeypatch.setattr(analytics, "SHALLOW_ROWS", 0)
        deep = [tuple(r) for r in analytics.paginate(df, ["k", "id"], page, 50).orderBy("k", "id").collect()]
        monkeypatch.undo()
        assert shallow == deep


VERDICT = '{{"is_bullying": true, "confidence": {c}, "severity": "{s}", "primary_category": "{p}", "detected_patterns": ["insults"], "risk_factors": ["aggressive_language"], "reasoning": "Contains direct insults", "recommended_action": "{a}"}}'


def test_verdict_reaches_the_explanation(spark):
    text = "the quick brown fox has a fine day"
    rows = [
        (1, text, VERDICT.format(c=0.9, s="high", p="direct_insults", a="block")), (2, text, VERDICT.format(c=0.7, s="medium", p="other", a="escalate")),
        (3, text, VERDICT.format(c=0.0, s="high", p="threats", a="block")), (4, "", VERDICT.format(c=0.9, s="high", p="threats", a="block")), (5, text, "no json"),
        (6, "you are so stupid", VERDICT.format(c=0.9, s="high", p="threats", a="block")),
    ]
    df = spark.createDataFrame(rows, "msg_id int, text string, raw string")
    got = {r["msg_id"]: r for r in ensemble(score_category(df.select("msg_id", "text")), parse_verdicts(df.select("msg_id", "raw")), policy="adaptive").collect()}
    assert got[1]["explanation"] == "Cyberbullying detected with high severity (63% confidence). Detected categories: direct_insults. Immediate action recommended."
    assert (got[1]["action"], got[1]["reasoning"], got[1]["risk_indicators"], got[1]["n_categories"]) == ("block", "Contains direct insults", ["aggressive_language"], 1)
    assert got[2]["explanation"] == "Cyberbullying detected with medium severity (35% confidence). Consider escalating to human moderator."
    assert got[2]["n_categories"] == 0
    for i in (3, 4, 5):  # no confidence, no text, no verdict: the local result stays
        assert got[i]["method"] == "local" and got[i]["action"] == "warn" and not got[i]["is_bullying"]
    assert got[6]["method"] == "local" and "threats" not in got[6]["explanation"]

"""Sources, sinks, streams and plan shapes."""

import json

import pytest
from pyspark.sql import functions as F

from civiltext.operators import lexicon as lx, matching as mt
from civiltext.operators.throttle import throttle
from civiltext.plans import planted
from civiltext.plans.category import score_category
from civiltext.plans.multilingual import score_multilingual
from civiltext.sources import readers, storage, writers
from civiltext.streaming import streams

SF = "/root/testdata/sf0.001"


def write_json(path, body):
    path.write_text(json.dumps(body, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_three_file_layouts(spark, tmp_path):
    langs = {"languages": {"hindi": {"single_words": ["x", "y"], "multi_word_phrases": ["p q"], "patterns": ["z+"], "severity_map": {"x": "high", "w": "low"}}}}
    rows = readers.read_lexicon(spark, write_json(tmp_path / "a.json", langs)).collect()
    assert {(r.term, r.kind, r.lang, r.severity) for r in rows} == {
        ("x", "word", "hindi", "high"), ("y", "word", "hindi", None), ("p q", "phrase", "hindi", None),
        ("z+", "pattern", "hindi", None), ("x", "severity", "hindi", "high"), ("w", "severity", "hindi", "low"),
    }
    cats = {"bullying_categories": {"c": {"keywords": ["One", "two three"], "multi_word_phrases": ["go on"], "patterns": ["k"]}}}
    rows = readers.read_lexicon(spark, write_json(tmp_path / "b.json", cats)).collect()
    assert {(r.term, r.kind, r.category, r.severity, round(r.boost, 3)) for r in rows} == {
        ("one", "word", "c", "medium", 0.3), ("two three", "phrase", "c", "medium", 0.3),
        ("go on", "phrase", "c", "medium", 0.45), ("k", "pattern", "c", "medium", 0.3),
    }
    old = {
        "bullying_words": ["Bad"], "bullying_phrases": ["so bad"], "severity_levels": {"low": ["Bad"]},
        "contextual_patterns": [{"pattern": "q", "severity": "high"}],
        "intent_indicators": [{"keywords": ["a", "b"], "severity": "low"}, {"keywords": ["a"]}],
    }
    path = write_json(tmp_path / "c.json", old)
    rows = readers.read_lexicon(spark, path).collect()
    assert {(r.term, r.kind, r.severity) for r in rows} == {("bad", "word", "low"), ("so bad", "phrase", "high"), ("q", "pattern", "high")}
    intents = readers.read_intents(spark, path).collect()
    assert {(r.indicator, r.keyword, r.severity) for r in intents} == {("0", "a", "low"), ("0", "b", "low"), ("1", "a", "medium")}


def test_snapshots_keep_versions(spark, tmp_path):
    path = str(tmp_path / "lex")
    lex = lx.packaged_lexicon(spark)
    assert writers.write_snapshot(lex, path) == 1
    fewer = lx.remove_terms(lex, spark.createDataFrame([(" STUPID ",)], "term string"))
    assert writers.write_snapshot(fewer, path) == 2
    assert writers.read_snapshot(spark, path).filter("term = 'stupid'").count() == 0
    assert writers.read_snapshot(spark, path, 1).filter("term = 'stupid'").count() == 2
    assert writers.snapshot_metadata(lex).first().total_words == 137


def test_export_and_results(spark, tmp_path):
    out = str(tmp_path / "words")
    writers.export_terms(lx.packaged_lexicon(spark), out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines.index("## Words") < lines.index("alone") < lines.index("bokya") < lines.index("## Phrases") < lines.index("tujhi aai")
    scored = score_multilingual(planted.planted_messages(spark, SF).select("msg_id", "text"))
    writers.write_results(scored, str(tmp_path / "parquet"))
    writers.write_results(scored, str(tmp_path / "json"), "json")
    back = spark.read.parquet(str(tmp_path / "parquet"))
    assert back.count() == scored.count()
    high = spark.read.text(str(tmp_path / "json")).filter("severity = 'high'").first().value
    assert json.loads(high)["success"] is True


def test_merge_matches_packaged_rules(spark):
    a, b = lx.inline_rules(lx.multilingual_lexicon(spark)), lx.packaged_rules()
    assert set(a) == set(b)
    for lang in a:
        assert set(a[lang].words) == set(b[lang].words) and set(a[lang].phrases) == set(b[lang].phrases)
        assert set(a[lang].patterns) == set(b[lang].patterns) and a[lang].natives == b[lang].natives
        assert {k: v for k, v in a[lang].severity.items()} == {k: v for k, v in b[lang].severity.items() if k in a[lang].severity}
    assert lx.inline_rules(lx.multilingual_lexicon(spark), max_terms=10) is None


def test_stream_scores_equal_batch_scores(spark):
    stream = streams.stream_table(spark, SF, "conversations").select("conv_id", "turn", "text")
    got = streams.run_append(streams.score_stream(stream)).select("conv_id", "turn", "confidence", "severity")
    want = score_multilingual(readers.read_table(spark, SF, "conversations")).select("conv_id", "turn", "confidence", "severity")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.fixture()
def event_files(spark, tmp_path):
    """The events in time order as several files, one per micro-batch."""
    ev = readers.read_table(spark, SF, "events")
    for i in range(4):
        ev.filter((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250)).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    return ev, str(tmp_path / "ev")


def test_throttle_stream_equals_batch(spark, event_files):
    ev, path = event_files
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.run_throttle(stream, "event_type", "ts", 7200)
    want = throttle(ev, "event_type", "ts", 7200)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_complete_mode_equals_batch(spark, event_files):
    ev, path = event_files
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.run_complete(streams.window_metrics(stream, "1 day"))
    want = streams.window_metrics(ev, "1 day")
    key = lambda r: (r.window_start, r.n, r.errors, round(r.mean_latency, 6))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_needs_no_shuffle_and_runs_once_under_a_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for scorer in (score_multilingual, score_category):
        scored = scorer(docs.select("doc_id", "text"))
        assert "Exchange" not in plan_of(scored)
        flagged = plan_of(scored.filter("is_bullying and severity = 'high'"))
        tokenised = plan_of(scored).count("regexp_extract_all")
        assert flagged.count("regexp_extract_all") <= tokenised


def test_scan_is_pruned_and_lookups_are_broadcast(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = plan_of(score_multilingual(docs.select("doc_id", "text")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    found = mt.match_words(mt.tokens(docs.withColumnRenamed("doc_id", "msg_id")), lx.packaged_lexicon(spark))
    plan = plan_of(found)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_large_inputs_are_not_spread(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "Exchange" in plan_of(readers.spread(docs, "doc_id"))
    assert "Exchange" not in plan_of(readers.spread(docs, "doc_id", split_bytes=10))


def test_shared_folder_comes_from_the_session(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

"""Plans that switch by the size of the term table give the same rows on both sides of the switch."""

import random

import pytest

from civiltext.operators import joins, lexicon as lx
from civiltext.plans.config_rules import score_config
from civiltext.plans.multilingual import score_multilingual, score_multilingual_joined

COLUMNS = ["msg_id", "text", "word_count", "languages", "detections", "n_detections", "confidence", "is_bullying", "severity", "detection_method"]


def lexicon_of(spark, rows):
    return spark.createDataFrame([(t, k, l, None, s, None, "test", 1) for t, k, l, s in rows], lx.LEXICON_SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Capitals, severity rows, repeated, blank and punctuated terms; repeated and null message keys."""
    rng = random.Random(13)
    levels = [None, "low", "medium", "high", "critical", "odd"]
    rows = [
        ("BAD Move", "native_phrase", "hindi", "high"), ("bad move", "native_phrase", "french", "medium"), ("", "native_phrase", "hindi", "high"),
        ("jerk", "word", "french", None), ("jerk", "severity", "french", "high"), ("don't you", "phrase", "french", "low"),
        (" you  jerk ", "phrase", "french", None), ("  ", "phrase", "french", None), ("@you go", "phrase", "marathi", "high"),
        ("\\E you", "phrase", "marathi", None), ("!!", "phrase", "danish", None), (r"\bgo+\b", "pattern", "danish", "high"),
        (r"\bgo+\b", "pattern", "danish", None),
    ]
    pool = ["jerk", "Jerk", "you", "YOU", "go", "fool"]
    for _ in range(60):
        kind = rng.choice(["word", "severity", "phrase", "native_phrase"])
        term = rng.choice(pool) if kind in ("word", "severity") else " ".join(rng.choices(pool, k=rng.randint(1, 3)))
        rows.append((term, kind, rng.choice(["french", "marathi", "danish"]), rng.choice(levels)))
    parts = pool + ["BAD Move", "bad move", "don't", "@you", "\\E", "!!", "goooo", "x", "y", "क्या", ","]
    texts = [(rng.choice([None, 1, 2, i]), " ".join(rng.choices(parts, k=rng.randint(1, 9)))) for i in range(500)]
    texts += [(7, None), (8, "  "), (9, "BAD Move"), (9, "BAD Move"), (9, "bad move"), (10, "jerk")]
    return lexicon_of(spark, rows), spark.createDataFrame(texts, "msg_id long, text string")


def rows_of(df, columns):
    assert set(columns) <= set(df.columns)
    return sorted(map(str, df.select(columns).collect()))


@pytest.mark.parametrize("gate", [True, False])
def test_multilingual_scores_do_not_depend_on_the_size_of_the_term_table(spark, awkward, gate, monkeypatch):
    lex, df = awkward
    inline = score_multilingual(df, lex, gate=gate)
    want = rows_of(inline, COLUMNS)
    assert rows_of(score_multilingual_joined(df, lex, gate=gate), COLUMNS) == want and len(want) == df.count()
    assert score_multilingual_joined(df, lex, gate=gate).columns == inline.columns
    if gate:
        monkeypatch.setattr(joins, "fits", lambda *a, **k: False)
        assert rows_of(score_multilingual_joined(df, lex), COLUMNS) == want


def test_native_capitals_and_severity_rows_count_in_the_joined_plan(spark):
    lex = lexicon_of(spark, [("BAD Move", "native_phrase", "english", "high"), ("jerk", "word", "english", None), ("jerk", "severity", "english", "high")])
    df = spark.createDataFrame([(1, "BAD Move"), (2, "bad move"), (3, "jerk")], "msg_id long, text string")
    for score in (score_multilingual, score_multilingual_joined):
        got = {r.msg_id: (r.confidence, r.severity) for r in score(df, lex).collect()}
        assert got == {1: (0.5, "high"), 2: (0.0, "none"), 3: (0.8, "high")}


def test_config_scores_do_not_depend_on_the_size_of_the_term_table(spark, awkward):
    lex, df = awkward
    indicators = {l: {"words": [w, "you"], "phrases": ["x"]} for l, w in (("french", "jerk"), ("marathi", "go"), ("danish", "fool"))}
    inline = score_config(df, lex, indicators=indicators)
    joined = score_config(df, lex, indicators=indicators, max_terms=5)
    assert joined.columns == inline.columns
    want = rows_of(inline, inline.columns)
    assert rows_of(joined, inline.columns) == want and len(want) == df.count()
    assert inline.filter("n_detections > 0").count() > 100

"""Results worked out by hand from the published rules."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civiltext.functions import text as tx
from civiltext.functions.phrases import gap_span
from civiltext.functions.sql import register
from civiltext.operators.analytics import confidence_bucket
from civiltext.operators.lexicon import multilingual_lexicon
from civiltext.operators.throttle import throttle
from civiltext.plans.category import score_category
from civiltext.plans.config_rules import score_config
from civiltext.plans.ensemble import ensemble, model_verdicts, parse_verdicts
from civiltext.plans.legacy import score_legacy
from civiltext.plans.multilingual import score_multilingual, score_multilingual_joined

MULTILINGUAL = [
    ("stupid", 0.4, "medium", 1), ("you are so stupid", 0.8, "medium", 2), ("stupid stupid stupid", 1.0, "medium", 3),
    ("nobody likes you", 0.75, "medium", 1), ("nobody really likes you", 0.675, "medium", 1),
    ("nobody actually really likes you at all", 0.63, "medium", 1), ("kill yourself", 0.75, "high", 1),
    ("go kill yourself", 1.0, "high", 2), ("go and die", 0.65, "high", 1), ("bokya", 0.8, "medium", 2),
    ("chutiya", 0.8, "high", 1), ("nalayak", 0.3, "low", 1), ("teri maa ki", 1.0, "high", 2),
    ("gaand maaru", 1.0, "medium", 3), ("tujhi aai", 1.0, "medium", 2), ("tera baap ka", 0.75, "medium", 1),
    ("तेरी माँ की", 0.9, "high", 2), ("चुतिया", 0.8, "medium", 2), ("stupid!!!", 0.4, "medium", 1),
    ("teri pyari maa ki", 0.0, "none", 0), ("nobody", 0.0, "none", 0), ("stup1d", 0.0, "none", 0),
    ("die", 0.0, "none", 0), ("kill the process", 0.0, "none", 0), ("nobody knows", 0.0, "none", 0),
    ("have a great day", 0.0, "none", 0), ("kya baat hai", 0.0, "none", 0), ("You are amazing", 0.0, "none", 0),
    ("   ", 0.0, "none", 0), (None, 0.0, "none", 0),
]


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id long, text string")


@pytest.mark.parametrize("plan", ["inline", "lexicon", "joined"])
def test_multilingual(spark, plan):
    df = table(spark, [g[0] for g in MULTILINGUAL])
    if plan == "inline":
        out = score_multilingual(df)
    elif plan == "lexicon":
        out = score_multilingual(df, multilingual_lexicon(spark))
    else:
        out = score_multilingual_joined(df, multilingual_lexicon(spark))
    got = {r.msg_id: (r.confidence, r.severity, r.n_detections, r.is_bullying) for r in out.collect()}
    for i, (text, conf, severity, n) in enumerate(MULTILINGUAL):
        c, s, m, flag = got[i]
        assert (round(c, 6), s, m, flag) == (conf, severity, n, n > 0), text


def test_without_language_gate_the_gapped_phrase_counts(spark):
    out = score_multilingual(table(spark, ["teri pyari maa ki"]), gate=False).first()
    assert out.n_detections == 1 and out.severity == "high"


def test_category(spark):
    rows = score_category(table(spark, ["stupid", "you are stupid", "kill yourself", "  "])).orderBy("msg_id").collect()
    assert [(round(r.confidence, 6), r.severity, r.is_bullying) for r in rows] == [
        (0.399, "medium", True), (0.8, "medium", True), (0.8, "high", True), (0.0, "none", False)
    ]
    assert rows[0].explanation.startswith("Cyberbullying detected with medium severity (40% confidence). Detected categories: direct_insults.")


def test_config(spark):
    texts = ["you are stupid", "stuuuuupid", "chutiya", "This is a normal message"]
    rows = score_config(table(spark, texts)).orderBy("msg_id").collect()
    assert [(round(r.confidence, 6), r.severity, r.is_bullying) for r in rows] == [
        (0.84, "medium", True), (0.3, "none", False), (0.0, "none", False), (0.0, "none", False)
    ]


def test_legacy(spark):
    rows = score_legacy(table(spark, ["Y0U 5UCK", "w0rthless", "fine", " "])).orderBy("msg_id").collect()
    assert [(round(r.confidence, 6), r.severity, r.is_bullying) for r in rows] == [
        (0.5, "high", True), (0.3, "high", True), (0.0, "none", False), (0.0, "none", False)
    ]
    assert "found_words" not in score_legacy(table(spark, ["x"]), details=False).columns


@pytest.mark.parametrize("raw", ["madarchod", "maderchood", "maderchod", "motherchod", "m@d@rch0d", "MADARCHOD", "MaDaRcHoD"])
def test_normalisation_pairs(spark, raw):
    assert table(spark, [raw]).select(tx.normalise("text", "category")).first()[0] == "madarchod"


def test_bang_becomes_a_letter_before_punctuation_is_cleaned(spark):
    assert table(spark, ["stupid!"]).select(tx.normalise("text", "category")).first()[0] == "stupidi"


def test_validation_edges(spark):
    rows = table(spark, ["", " ", "a" * 5001, "123456789", "!@#$%^&*()", None]).select(tx.text_issues("text").alias("i")).collect()
    assert [list(r.i) for r in rows] == [["blank"], ["blank"], ["too_long"], [], [], ["not_text"]]


def test_verdicts(spark):
    df = spark.createDataFrame(
        [(0, '{"is_bullying": true, "confidence": 1.7, "severity": "high"}'), (1, "this is bullying"), (2, "severe, yes"), (3, None)],
        "msg_id long, raw string",
    )
    a = parse_verdicts(df).orderBy("msg_id").collect()
    assert (a[0].v_confidence, a[0].v_severity, a[0].v_is_bullying) == (1.0, "high", True)
    assert (a[1].v_confidence, a[1].v_severity, a[1].v_is_bullying) == (0.5, "medium", True)
    b = parse_verdicts(df, fallback="legacy").orderBy("msg_id").collect()
    assert (b[1].v_confidence, b[2].v_confidence, b[2].v_severity) == (0.6, 0.8, "high")
    assert (b[3].v_confidence, b[3].v_is_bullying) == (0.0, False)


def test_throttle(spark):
    rows = [("k", s, i) for i, s in enumerate([0, 1800, 3599, 3600, 7199, 7200])]
    df = spark.createDataFrame(rows, "k string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(r.event_id for r in throttle(df, "k", "ts").collect())
    assert got == [0, 3, 5]


def test_histogram_buckets(spark):
    df = spark.createDataFrame([(0.4,), (0.75,), (1.0,)], "confidence double")
    assert [r[0] for r in df.select(confidence_bucket("confidence")).collect()] == [40, 70, 100]


@pytest.mark.parametrize(
    "text, phrase, found",
    [
        ("nobody likes you", "nobody likes you", True), ("nobody really likes you", "nobody likes you", True),
        ("nobody actually really likes you", "nobody likes you", True), ("you likes nobody", "nobody likes you", False),
        ("teri maa ki gaali", "teri maa ki", True), ("teri behen ki maa", "teri maa ki", False),
    ],
)
def test_phrase_sequence_pairs(spark, text, phrase, found):
    span = table(spark, [text]).select(gap_span(F.col("text"), phrase.split())).first()[0]
    assert (span is not None) is found


def test_sql_functions(spark):
    register(spark)
    row = spark.sql(
        "SELECT sev_rank('high') a, severity_band(0.85D) b, confidence_bucket(0.75D) c, deleet_config('5tup1d') d, "
        "normalise_legacy('Y0U!!!') e, size(word_tokens('Go away, NOW')) f"
    ).first()
    assert tuple(row) == (3, "high", 70, "stupid", "youiii", 3)


def test_model_verdicts_feed_the_ensemble(spark):
    def predict(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: '{"is_bullying": true, "confidence": 0.9, "severity": "high"}' if "odd" in t else "{}")

    df = table(spark, ["an odd text", "plain"])
    verdicts = parse_verdicts(model_verdicts(df, predict))
    rows = ensemble(score_legacy(df, details=False), verdicts).orderBy("msg_id").collect()
    assert [(round(r.confidence, 6), r.is_bullying, r.severity, r.method) for r in rows] == [
        (0.54, True, "high", "combined"), (0.0, False, "none", "combined")
    ]


def test_preview_and_html(spark):
    df = table(spark, ["x" * 51])
    assert df.select(tx.preview("text")).first()[0] == "x" * 47 + "..."
    page = table(spark, ["<b>hi</b><SCRIPT a=1>var x = '<';</script> there "])
    assert page.select(tx.sanitise_html("text")).first()[0] == "hi there"


def test_verdicts_on_blank_and_short_texts(spark):
    """A blank text asks for no verdict; a short one is lowered after the verdict is mixed in."""
    from civiltext.plans.category import score_category
    from civiltext.plans.ensemble import ensemble, parse_verdicts

    texts = [(1, "   "), (2, "die"), (3, "thank you")]
    verdict = '{"is_bullying": true, "confidence": %s, "severity": "high", "primary_category": "threat", "recommended_action": "block"}'
    raw = [(1, verdict % 0.85), (2, verdict % 1.0), (3, verdict % 0.85)]
    local = score_category(spark.createDataFrame(texts, "msg_id long, text string"))
    verdicts = parse_verdicts(spark.createDataFrame(raw, "msg_id long, raw string"))
    for policy in ("fixed", "adaptive"):
        got = {r.msg_id: r for r in ensemble(local, verdicts, policy=policy).collect()}
        assert (got[1].confidence, got[1].is_bullying, got[1].severity, got[1].method) == (0.0, False, "none", "local")
    assert abs(got[2].confidence - 0.56) < 1e-9 and abs(got[3].confidence - 0.476) < 1e-9

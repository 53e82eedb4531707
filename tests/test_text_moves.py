"""Texts stay where they are and are lowered once."""

import random
import re

from pyspark.sql import functions as F

from civiltext.functions.staging import required_literals, spaced_literals, widest_match
from civiltext.operators import rule_patterns
from civiltext.plans import queries
from civiltext.plans.category import add_features, score_category


def test_pattern_candidates_move_no_text(spark):
    rng = random.Random(5)
    words = ["over", "the", "hill", "stone", "river", "été", "漢字字", "ab"]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", "--", ", ", "x", "\n\n\n\n"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    texts += [(None, "over hill"), (7, "stone  river"), (7, "stone  river"), (8, None), (9, "")]
    df = spark.createDataFrame(texts, "msg_id int, text string")
    table = [
        "hill[^a-z]{1,3}stone", "over.?the", "river.*hill", "été[ x]{0,2}漢字字", "stone x?river", r"hill\s{2}", "ab+o", "over(the)?hill", "[xy]", "the-{2,}ab",
        "hill.{1,16}river.{0,3}over", "hill.{20}over", "a{2}", "STONE RIVER", r"\bover\b", "hill.stone.*ab",
    ]
    patterns = spark.createDataFrame([(p, lang) for p in table for lang in ("x", None)], "term string, lang string")
    few = rule_patterns.match_few(df, patterns.collect(), "msg_id", "text")
    rows = lambda found: sorted(map(str, found.select("msg_id", "pattern", "lang", "values").collect()))
    want = rows(few)
    assert len(want) > 500
    for most in (None, 5):  # all at once, and in blocks
        found = rule_patterns.match_many(df, patterns, "msg_id", "text", in_tasks=most)
        assert rows(found) == want
    plan = rule_patterns.match_many(df, patterns.filter("term LIKE '%hill%'"), "msg_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_long_texts_are_tried_around_the_anchors_alone(spark):
    rng = random.Random(8)
    words = ["over", "hill", "stone", "é漢", "😀", "ab", "hillstone"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "--", ", ", "x", "\n"]) for _ in range(n))
    df = spark.createDataFrame([(i, text(rng.choice([0, 3, 40, 400]))) for i in range(120)] + [(9, "漢hill漢stone漢"), (None, "hillxstone")], "msg_id int, text string")
    table = ["hill[^a-z]{1,3}stone", "over.?hill", "é漢[ x]{0,2}😀", "hill.{1,9}hill", "ab.{0,3}ab", "HILL[^é]{0,2}stone.{2}", "stone", r"hill\sstone", "stone.*ab", r"\bhill\b", "x?over[-, ]{2}.", "hill.{0,4}?stone", "hill.{0,4}+stone"]
    patterns = spark.createDataFrame([(p, "x") for p in table], "term string, lang string")
    rows = lambda found: sorted(map(str, found.select("msg_id", "pattern", "lang", "values").collect()))
    want = rows(rule_patterns.match_few(df, patterns.collect(), "msg_id", "text"))
    assert rows(rule_patterns.match_many(df, patterns, "msg_id", "text")) == want and len(want) > 300
    near = patterns.filter("term = 'hill[^a-z]{1,3}stone'").mapInArrow(rule_patterns._anchors, "term string, lang string, _a long, _a_size int, _b long, _b_size int, _reach int, _rest array<string>, _width int")
    long = spark.createDataFrame([(1, "over " * 9999 + "hill  stone" + " over" * 9999 + " hill,stone")], "msg_id int, _low string")
    [row] = rule_patterns.with_candidates(long, "msg_id", rule_patterns.Index(near.toArrow())).collect()
    assert row["_low"] is None and [len(p) < 100 for r in row["_rules"] for p in r["_parts"]] == [True, True]


def test_widest_match():
    assert widest_match("hill[^a-z]{1,3}é.?") == 4 + 12 + 2 + 4
    assert widest_match(r"a\s{2}") == 9
    for unknown in (r"\bab", "a+", "a{2,}", "(ab)", "a|b", "^ab", "ab$", "[a[b]]{3}", "ab?+", "a{2}?", "[a", "[a&&b]", "ab*"):
        assert widest_match(unknown) is None


def test_spaced_literals_bound_what_stands_between():
    assert spaced_literals("hill[^a-z]{1,3}stone") == [("hill", 0), ("stone", 3)]
    assert spaced_literals(r"ab.*cd\s?ef") == [("ab", 0), ("cd", None), ("ef", 1)]
    assert spaced_literals("abc+de.{2}x.fg") == [("abc", 0), ("de", None), ("fg", 4)]
    assert spaced_literals("ab(c|d)ef") == [("ab", 0), ("ef", None)]
    assert required_literals("ab(c|d)ef") == ["ab", "ef"]


def test_a_text_is_lowered_once(spark):
    df = spark.createDataFrame([(1, "You ARE so stupid"), (2, "İ will KILL you you"), (3, None)], "msg_id int, text string")
    for out, column in ((add_features(df), "context"), (score_category(df), "confidence")):
        plan = out.select(column)._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"\blower\(", plan)) == 1
    # guards of the intent rules keep each rule's matches
    texts = ["kill yourself", "i will hurt", "watch  out", "you are so ugly", "such a freak", "i hate you", "nobody cares about you", "you don't belong", "you"]
    got = add_features(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", F.col("intent")).collect()
    assert {r["text"]: max(r["intent"]) for r in got} == dict(zip(texts, [0.3, 0.3, 0.3, 0.4, 0.4, 0.8, 0.4, 0.4, 0.0]))


def test_patterns_are_mined_once(spark):
    plan = queries.phrase_patterns(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1

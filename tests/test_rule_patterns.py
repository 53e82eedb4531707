"""Faulty rules set aside, pattern index, rolling-hash substrings, adaptive phrases as a band join: against plain versions."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from civiltext.functions.phrases import adaptive_matches, keep_strongest
from civiltext.functions.text import word_tokens
from civiltext.operators import matching, rule_patterns, substrings
from civiltext.operators.word_pairs import adaptive_phrases
from civiltext.plans.category import score_category
from civiltext.plans.legacy import LegacyRules, score_legacy
from civiltext.plans.multilingual import score_multilingual
from civiltext.plans.term_profiles import category_terms, score_category_table, score_legacy_table

RULES = [
    ("stupid", "word", "english"), ("(unclosed", "pattern", "english"), ("[z-a]", "pattern", "english"), (r"you\s+are\s+so", "pattern", "english"), ("   ", "word", "english"),
    (None, "word", "english"), (None, "pattern", "english"), ("x" * 60, "word", "english"), ("x" * 60, "pattern", "english"), ("ok", "rumour", "english"), ("ok", None, "english"),
    ("*", "pattern", "hindi"), ("*", "pattern", "english"), ("kill yourself", "phrase", "english"), (r"\p{Nonsense}", "pattern", "english"),
]
COLUMNS = "term string, kind string, lang string, category string, severity string, boost double, origin string, version int"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([(*r, None, None, None, "user", 1) for r in RULES], COLUMNS)


def test_quarantine_splits_all_rows_with_a_reason(spark, rules):
    valid, rejected = rule_patterns.quarantine(rules)
    reasons = sorted((r["term"] or "", r["kind"] or "", r["reason"]) for r in rejected.collect())
    assert reasons == sorted([
        ("(unclosed", "pattern", "invalid expression"), ("[z-a]", "pattern", "invalid expression"), ("*", "pattern", "invalid expression"), ("*", "pattern", "invalid expression"),
        (r"\p{Nonsense}", "pattern", "invalid expression"), ("   ", "word", "blank"), ("", "word", "blank"), ("", "pattern", "blank"), ("x" * 60, "word", "too long"),
        ("ok", "rumour", "unknown kind"), ("ok", "", "unknown kind"),
    ])
    assert valid.columns == rules.columns and valid.count() + len(reasons) == len(RULES)


def test_faulty_patterns_leave_the_scores_of_others_alone(spark, rules):
    texts = spark.createDataFrame([(1, "you are so stupid"), (2, "kill yourself"), (3, "(unclosed"), (4, None)], "msg_id int, text string")
    good = rules.filter("kind <> 'pattern' OR term RLIKE '^you' OR term LIKE 'x%'")
    pick = lambda df: sorted(map(tuple, df.select("msg_id", F.round("confidence", 6), "severity", "n_detections").collect()))
    assert pick(score_multilingual(texts, rules)) == pick(score_multilingual(texts, good))
    assert pick(score_multilingual(texts, rules))[0][3] == 2


def test_index_finds_what_the_plain_scan_finds(spark):
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choices("abcde", k=rng.randint(a, b)))
    words = [word(2, 7) for _ in range(60)]
    shapes = [lambda a, b: f"{a}\\s+{b}", lambda a, b: f"({a}|{b})", lambda a, b: f"{a}.{{0,3}}{b}", lambda a, b: f"^{a}", lambda a, b: f"\\b{a[:2]}\\b", lambda a, b: f"[{a}]{b}+", lambda a, b: f"({a}", lambda a, b: f"{a}?{b}"]
    patterns = {(rng.choice(shapes)(rng.choice(words), rng.choice(words)), rng.choice(["x", "y"])) for _ in range(300)}
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))).title()) for i in range(80)] + [(None, words[0]), (5, "same key " + words[1]), (7, None), (8, "")]
    df = spark.createDataFrame(texts, "msg_id int, text string")
    table = spark.createDataFrame(sorted(patterns) + [(None, "x")], "term string, lang string")
    rows = lambda found: sorted((str(r["msg_id"]), r["pattern"], r["lang"], r["values"], r["hits"]) for r in found.collect())
    joined = rows(matching.match_patterns(df, table, inline=0))
    assert joined == rows(matching.match_patterns(df, table, inline=10_000)) and len(joined) > 500
    assert rows(matching.match_patterns(df, table.limit(0))) == []


def test_ten_thousand_patterns_need_no_scan_of_their_own(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=7))
    words = [word() for _ in range(10_000)]
    df = spark.createDataFrame([(i, " ".join(words[i * 7 : i * 7 + 7])) for i in range(500)], "msg_id int, text string")
    table = spark.createDataFrame([(rf"{a}\s+{b}", "x") for a, b in zip(words, words[1:])], "term string, lang string")
    found = matching.match_patterns(df, table)
    assert found.count() == 500 * 6
    # once for the texts themselves, once for their pieces
    assert found._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") <= 4


# -- substrings ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [6, 25])
def test_contained_terms_equal_contains(spark, monkeypatch, bits):
    monkeypatch.setattr(substrings, "FILTER_BITS", 25)
    rng = random.Random(bits)
    chars = "abé漢😀 "
    make = lambda a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    texts = [(i, make(0, 60)) for i in range(150)] + [(None, "ab"), (3, "ab" * 10), (3, "ab" * 10), (4, None)]
    table = list({make(1, 4) for _ in range(120)}) + ["", "ab", "a" * 300]
    df = spark.createDataFrame(texts, "k int, t string")
    got = substrings.contained_terms(df, spark.createDataFrame([(x, i) for i, x in enumerate(table)], "term string, n int"), "k", "t")
    want = [(k, x, i) for k, t in texts if t is not None for i, x in enumerate(table) if x and x in t]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# -- phrases and profiles -------------------------------------------------------------------------------


def test_band_join_equals_the_inline_phrases(spark):
    rng = random.Random(9)
    vocabulary = ["you", "are", "so", "kill", "stupid", "go", "of", "nobody", "likes", "worthless"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(200)]
    phrases = ["go go", "you are so stupid", "nobody likes you", "kill you", "so", "are you so you are worthless", "of go"]
    df = spark.createDataFrame(texts, "msg_id int, text string").withColumn("w", word_tokens("text"))
    toks = df.select("msg_id", F.posexplode("w").alias("pos", "token"))
    sizes = df.select("msg_id", F.size("w").alias("n_tokens"))
    joined = matching.match_phrases_adaptive(toks, sizes, spark.createDataFrame([(p,) for p in phrases], "term string"))
    rows = lambda found: sorted(map(tuple, found.select("msg_id", "term", "start", "end", "gaps", F.round("strength", 6)).collect()))
    each = [df.select("msg_id", F.lit(p).alias("term"), F.inline(adaptive_matches(F.col("w"), p))) for p in phrases]
    inline = each[0]
    for e in each[1:]:
        inline = inline.unionByName(e)
    assert rows(joined) == rows(inline) and joined.count() > 200
    kept = [df.select("msg_id", F.lit(p).alias("term"), F.inline(keep_strongest(adaptive_matches(F.col("w"), p)))) for p in phrases]
    union = kept[0]
    for k in kept[1:]:
        union = union.unionByName(k)
    assert rows(matching.resolve_overlaps(joined)) == rows(union)


MESSAGES = [
    (1, "you are so stupid"), (2, "kill yourself, idiot"), (3, "die"), (4, "Nobody likes you"), (5, ""), (6, None), (7, "thank you"), (8, "GO AWAY!!!! nobody wants you here you worthless idiot"),
    (None, "stupid stupid"), (1, "hello there"), (9, "you should die and go kill yourself now"), (10, "your"),
]


def test_category_profile_from_a_table(spark):
    df = spark.createDataFrame(MESSAGES, "msg_id int, text string")
    cols = ["msg_id", F.round("confidence", 6), "is_bullying", "severity", "n_categories", F.col("risk_indicators").cast("string"), "explanation", F.transform("categories", lambda c: c["category"]).cast("string"),
            F.transform("categories", lambda c: F.array_join(F.array_sort(c["items"]), "|")).cast("string"), F.transform("categories", lambda c: F.round(c["score"], 6)).cast("string")]
    rows = lambda found: sorted(map(str, map(tuple, found.select(*cols).collect())))
    table = category_terms(spark).unionByName(spark.createDataFrame([("(open", "pattern", "threats", "high", 0.5)], category_terms(spark).schema))
    assert rows(score_category_table(df, table)) == rows(score_category(df))
    many = table.unionByName(spark.range(5_000).selectExpr("translate(concat('zet', id, ' ret', id), '0123456789', 'bcdfghjklm') term", "'phrase' kind", "'extra' category", "'low' severity", "0.2D boost"))
    assert rows(score_category_table(df, many)) == rows(score_category(df))
    hit = score_category_table(spark.createDataFrame([(1, "a zethj of rethj")], "msg_id int, text string"), many).collect()[0]
    assert [(c["category"], c["items"], c["severity"]) for c in hit["categories"]] == [("extra", ["zethj rethj"], "low")]


def test_legacy_profile_from_a_table(spark):
    df = spark.createDataFrame(MESSAGES, "msg_id int, text string")
    known = LegacyRules(patterns=[(r"kill\s+\w+", "high")], intents=[(["stupid", "you"], "high")])
    rows_ = [(t, k, known.severity.get(t)) for k, ts in (("word", known.words), ("phrase", known.phrases)) for t in ts] + [(r"kill\s+\w+", "pattern", "high"), ("[", "pattern", "high"), ("", "word", None)]
    lex = spark.createDataFrame(rows_, "term string, kind string, severity string")
    cols = ["msg_id", F.round("confidence", 6), "is_bullying", "severity", "total_indicators", "word_count", F.array_sort("found_words").cast("string"), F.array_sort("found_phrases").cast("string"), "found_patterns"]
    rows = lambda found: sorted(map(str, map(tuple, found.select(*cols).collect())))
    assert rows(score_legacy_table(df, lex, intents=known.intents)) == rows(score_legacy(df, known))
    none = score_legacy_table(spark.createDataFrame([(1, "you you")], "msg_id int, text string"), lex.filter("kind = 'phrase'"), threshold=0.1, intents=known.intents).collect()[0]
    assert none["is_bullying"] and none["total_indicators"] == 0


def test_phrases_in_the_tasks_and_joined_give_equal_rows_and_move_no_pairs(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 60)))) for i in range(150)]
    phrases = ["a b", "b a", "c c", "a b c", "a b d e", "h g", "a", "  x"]
    df = spark.createDataFrame(texts, "msg_id int, text string").select("msg_id", word_tokens("text").alias("w")).withColumn("n_tokens", F.size("w"))
    table = spark.createDataFrame([(p,) for p in phrases], "term string")
    found = {most: adaptive_phrases(df, table, in_tasks=most) for most in (100, 0)}
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(found[100]) == rows(found[0])
    inline = [df.select("msg_id", F.lit(p).alias("term"), F.inline(adaptive_matches(F.col("w"), p))) for p in phrases[:6]]
    union = inline[0]
    for e in inline[1:]:
        union = union.unionByName(e)
    cols = ["msg_id", "term", "start", "end", "gaps", F.round("strength", 6)]
    got = found[100].select("msg_id", "term", F.inline("m")).filter("term <> 'a'")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, union.select(*cols).collect())) and got.count() > 500
    # a pair that is met may not be moved: words of frequent phrases are in most messages
    plan = found[100]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan

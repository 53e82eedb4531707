"""Set-based and row-local forms equal simple sequential ones on random small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from civiltext.functions import phrases as ph
from civiltext.functions import text as tx
from civiltext.functions.staging import required_literal
from civiltext.operators import joins, lexicon as lx, matching as mt
from civiltext.operators.analytics import global_row_number
from civiltext.operators.throttle import throttle
from civiltext.plans import planted
from civiltext.plans.multilingual import score_multilingual
from civiltext.values import rules


def nearest_chain(words, phrase, gap):
    """First (start, end) of the greedy scan, else None."""
    for i, w in enumerate(words):
        if w != phrase[0]:
            continue
        at = i
        for p in phrase[1:]:
            at = next((j for j in range(at + 1, min(at + gap + 2, len(words))) if words[j] == p), None)
            if at is None:
                break
        if at is not None:
            return i, at
    return None


PHRASES = ["a b", "a b c", "a a b", "b a c a"]


@pytest.fixture(scope="module")
def random_texts(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("aabbcxy") for _ in range(rng.randint(1, 14)))) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "msg_id long, text string")


def test_gap_regex_and_join_equal_the_scan(spark, random_texts):
    rows, df = random_texts
    spans = df.select("msg_id", *[ph.gap_span(F.col("text"), p.split()).alias(f"p{i}") for i, p in enumerate(PHRASES)])
    got = {r.msg_id: r for r in spans.collect()}
    table = spark.createDataFrame([(p, "x", "medium") for p in PHRASES], "term string, lang string, severity string")
    joined = {(r.msg_id, r.term): (r.start, r.end) for r in mt.match_phrases(mt.tokens(df), table).collect()}
    for i, text in rows:
        for k, p in enumerate(PHRASES):
            want = nearest_chain(text.split(), p.split(), 2)
            assert joined.get((i, p)) == want, (text, p)
            assert got[i][f"p{k}"] == (None if want is None else want[1] - want[0] + 1), (text, p)


def brute_adaptive(words, phrase):
    """All starting positions, windows and strengths, then the ordered removal of overlaps."""
    n, size = len(phrase), len(words)
    bucket = "short" if size < 10 else "medium" if size < 20 else "long"
    windows = ph.search_windows(phrase, bucket)
    weights = [ph.word_importance(w, i, n) for i, w in enumerate(phrase)]
    found = []
    for start in range(size):
        at, places, penalties = start, [], []
        for w, window, weight in zip(phrase, windows, weights):
            hit = next((j for j in range(at, min(at + window + 1, size)) if words[j] == w), None)
            if hit is None:
                break
            gap = hit - at
            penalties.append(0.0 if gap == 0 else min(min(gap * 0.15, 0.6) + (1 - weight) * 0.3, 0.8))
            places.append(hit)
            at = hit + 1
        if len(places) < n:
            continue
        span = places[-1] - places[0] + 1
        edge = min(places[0] / size, (size - places[-1]) / size)
        strength = n / span * 0.3 + sum(weights) / n * 0.25 + (1 - sum(penalties) / n) * 0.25 + (1 - edge * 0.1) * 0.2
        found.append((places[0], places[-1], max(0.1, min(strength + min(n * 0.05, 0.15), 1.0))))
    kept = []
    for m in sorted(found, key=lambda m: (-m[2], m[0])):
        shared = lambda k: max(0, min(m[1], k[1]) - max(m[0], k[0]) + 1) / min(m[1] - m[0] + 1, k[1] - k[0] + 1)
        if all(shared(k) <= 0.5 for k in kept):
            kept.append(m)
    return sorted((a, b, round(s, 9)) for a, b, s in kept)


@pytest.mark.parametrize("phrase", ["kill you", "nobody likes you", "go you go"])
def test_adaptive_matches_equal_brute_force(spark, phrase):
    rng = random.Random(3)
    pool = phrase.split() * 2 + ["x", "y"]
    rows = [(i, [rng.choice(pool) for _ in range(rng.randint(1, 26))]) for i in range(600)]
    df = spark.createDataFrame(rows, "msg_id long, w array<string>")
    out = df.select("msg_id", ph.keep_strongest(ph.adaptive_matches(F.col("w"), phrase)).alias("m"))
    got = {r.msg_id: sorted((m["start"], m["end"], round(m["strength"], 9)) for m in r.m) for r in out.collect()}
    table = df.select("msg_id", F.lit(phrase).alias("term"), F.inline(ph.adaptive_matches(F.col("w"), phrase)))
    rel = {}
    for r in mt.resolve_overlaps(table).collect():
        rel.setdefault(r.msg_id, []).append((r.start, r.end, round(r.strength, 9)))
    for i, w in rows:
        want = brute_adaptive(w, phrase.split())
        assert got[i] == want, w
        assert sorted(rel.get(i, [])) == want, w


def test_phrase_profile_equals_the_inline_profile(spark):
    table = spark.createDataFrame([(p,) for p in ("kill yourself", "nobody likes you", "go and you should die", "a b")], "term string")
    for r in lx.phrase_profile(table).collect():
        words = r.term.split()
        assert r.importance == pytest.approx(ph.word_importance(r.word, r.place, len(words)))
        for b in ("short", "medium", "long"):
            assert r[f"window_{b}"] == ph.search_windows(words, b)[r.place]


def test_variant_groups_equal_one_by_one(spark):
    rng = random.Random(5)
    pieces = [v for v, _ in rules.CATEGORY_VARIANTS] + ["x", " ", " ", "-", "ok"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.o for r in df.select("i", tx.rewrite_variants("t", rules.CATEGORY_VARIANTS).alias("o")).collect()}
    for i, t in enumerate(texts):
        want = t
        for v, s in rules.CATEGORY_VARIANTS:
            want = re.sub(r"\b" + re.escape(v) + r"\b", s, want)
        assert got[i] == want, t


def test_category_tokens_equal_tokens_of_the_normaliser(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("aabk!*--__@#|<>/\\ .?~`é1 \n") for _ in range(30)) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a, b = tx.category_tokens("t"), tx.extract(tx.normalise("t", "category"), tx.WORD)
    assert df.filter(a != b).count() == 0


def test_throttle_equals_a_sequential_scan(spark):
    rng = random.Random(11)
    rows = [(rng.choice("pqqqqq"), rng.randint(0, 60_000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    for ttl in (50, 700, 20_000):
        want, last = set(), {}
        for k, s, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
            if k not in last or s - last[k] >= ttl:
                last[k] = s
                want.add(i)
        assert {r.event_id for r in throttle(df, "k", "ts", ttl).collect()} == want


def test_salted_lookup_equals_broadcast(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(500)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k0", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = joins.lookup_join(left, right, ["k"], how).collect()
        large = joins.lookup_join(left, right, ["k"], how, max_rows=0, salts=5).collect()
        assert sorted(map(tuple, small), key=str) == sorted(map(tuple, large), key=str)


def test_large_tables_take_the_other_way_with_equal_results(spark, monkeypatch):
    msgs = planted.planted_messages(spark, "/root/testdata/sf0.001").filter("length(text) < 600")
    lex = lx.multilingual_lexicon(spark)
    terms = lex.filter(F.col("kind").isin("phrase", "native_phrase")).unionByName(
        lex.limit(1).withColumn("term", F.lit("u "))
    )
    small = sorted(map(tuple, mt.match_substrings(msgs, terms).collect()), key=str)
    kws = spark.createDataFrame(
        [("i0", "stupid", "high"), ("i0", "you", "high"), ("i1", "you", "high"), ("i1", "yo", "low")],
        "indicator string, keyword string, severity string",
    )
    ready = msgs.withColumn("norm", F.lower("text")).withColumn("tokens", tx.strip_punct_tokens("norm"))
    few = sorted((r.msg_id, round(r.intent_score, 9)) for r in mt.intent_keywords(ready, kws).collect())
    monkeypatch.setattr(joins, "fits", lambda *a, **k: False)
    assert small and few
    assert sorted(map(tuple, mt.match_substrings(msgs, terms).collect()), key=str) == small
    assert sorted((r.msg_id, round(r.intent_score, 9)) for r in mt.intent_keywords(ready, kws).collect()) == few


def test_score_unique_splits_hot_texts(spark):
    rows = [(i, "you are so stupid" if i % 3 else f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "msg_id long, text string")
    out = mt.score_unique(df, score_multilingual, hot=7)
    got = {r.msg_id: round(r.confidence, 6) for r in out.collect()}
    assert len(got) == 200 and out.count() == 200
    assert all(got[i] == (0.8 if i % 3 else 0.0) for i in range(200))


def test_global_row_number(spark):
    ids = random.Random(1).sample(range(10**9), 3000)
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.rn for r in global_row_number(df, "id", rows_per_bucket=200).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(ids))}


def test_confidence_is_bounded_and_grows_with_the_lexicon(spark):
    msgs = planted.planted_messages(spark, "/root/testdata/sf0.001")
    lex = lx.multilingual_lexicon(spark)
    more = lx.upsert_terms(lex, spark.createDataFrame([("the",), (" Nice Day ",), ("the",)], "term string"), "english")
    assert more.count() == lex.count() + 2
    a = score_multilingual(msgs, lex).select("msg_id", F.col("confidence").alias("a"))
    b = score_multilingual(msgs, more).select("msg_id", F.col("confidence").alias("b"))
    both = a.join(b, "msg_id")
    assert both.filter("a < 0 or b > 1 or b < a - 1e-9").count() == 0
    assert both.filter("b > a").count() > 0


@pytest.mark.parametrize(
    "pattern, literal",
    [(r"\bgo\s+die\b", "die"), (r"(foo)?bar+", "bar"), (r"ab?c", None), (r"a|bcd", None), (r"\x41bc", None), (r"[ab]cd", "cd")],
)
def test_required_literal(pattern, literal):
    assert required_literal(pattern) == literal


def test_required_literal_is_in_every_match():
    """Random patterns with quantifiers, groups, classes and alternatives: the guard never hides a match."""
    import random
    import re

    from civiltext.functions.staging import required_literal

    rng = random.Random(1)
    atoms = ["a", "b", "lo", "ser", "c", " ", ".", "[ab]", "(?:ab|c)", "(ab)", r"\b", r"\s", r"\w", "[^a]"]
    quantifiers = ["", "", "", "?", "*", "+", "{2}", "{0,2}", "{1,3}", "{2,}", "??", "+?", "{0}"]
    certain = 0
    for _ in range(3000):
        pattern = "".join(a + (rng.choice(quantifiers) if a != r"\b" else "") for a in rng.choices(atoms, k=rng.randint(1, 6)))
        if rng.random() < 0.05:
            pattern += "|" + rng.choice(atoms)
        literal = required_literal(pattern)
        if literal is None:
            continue
        certain += 1
        for _ in range(10):
            text = "".join(rng.choices(["a", "b", "lo", "ser", "c", " ", "ab"], k=rng.randint(0, 8)))
            assert all(literal in m.group() for m in re.finditer(pattern, text)), (pattern, literal, text)
    assert certain > 500
    assert required_literal(r"\blo{2,10}ser\b") == "ser" and required_literal("!{3,}") is None and required_literal("a{10}") is None


def test_quantified_patterns_match(spark):
    from civiltext.functions.staging import pattern_found

    df = spark.createDataFrame([("you looooser",), ("loser",), ("stop!!!!",)], "t string")
    got = df.select(pattern_found(df.t, r"\blo{2,10}ser\b").alias("a"), pattern_found(df.t, "!{3,}").alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True)]


def test_sql_normaliser_strips_like_the_column(spark):
    from civiltext.functions import sql

    sql.register(spark)
    df = spark.createDataFrame([("\n\tHi there!!! ",), ("  X  y\x1c",), (" plain ",), ("",), (None,)], "t string")
    got = df.select(F.expr("normalise_multilingual(t)").alias("a"), tx.normalise("t", "multilingual").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a == "hi there!"


def test_sql_normalisers_and_word_table_equal_the_columns(spark):
    import random

    from civiltext.functions import sql

    sql.register(spark)
    draw = random.Random(5)
    bits = ["fuk", "f**k", "sh1t", "a$$", "h8r", "||", "|\\", "\\/\\/", "><", "coool", "noooo", "!!!", "??", "....", "--", "a-b", " ", " ", "\n", "\x1c", "é", "नमस्ते", "'", "K1LL", "$1", "\\"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "i int, t string")
    for profile in ("category", "config"):
        got = df.select("t", F.expr(f"normalise_{profile}(t)").alias("a"), tx.normalise("t", profile).alias("b")).collect()
        assert [r for r in got if r.a != r.b] == []
    df.createOrReplaceTempView("said")
    places = spark.sql("SELECT i, place, word FROM said, LATERAL word_places(t)")
    want = df.select("i", F.posexplode(tx.word_tokens("t")).alias("place", "word"))
    assert sorted(map(tuple, places.collect())) == sorted(map(tuple, want.collect()))


def test_repeated_and_empty_keywords_count_once_at_any_size(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["you", "are", "dumb"], "you are dumb"), (2, ["fine"], "fine")], "msg_id long, tokens array<string>, norm string")
    table = spark.createDataFrame([("g", "dumb", "high"), ("g", "Dumb", "high"), ("g", "", "low"), ("h", "dumb", "low")], "indicator string, keyword string, severity string")
    small = {r.msg_id: round(r.intent_score, 6) for r in mt.intent_keywords(df, table).collect()}
    monkeypatch.setattr(joins, "fits", lambda *a, **k: False)
    large = {r.msg_id: round(r.intent_score, 6) for r in mt.intent_keywords(df, table).collect()}
    assert small == large == {1: 0.2}

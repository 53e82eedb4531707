"""A merge moves its rows once and takes ratings of the same language and spelling."""

import random

from civiltext.operators import lexicon as lx
from civiltext.plans import queries


def test_merge_equals_a_plain_merge(spark):
    rng = random.Random(2)

    def table(origin, n):
        rows = {(rng.choice("abcde") if rng.random() < 0.9 else None, rng.choice(["word", "phrase", "severity", None]), rng.choice(["x", "y", None])): None for _ in range(n)}
        rows = [(*k, rng.choice(["c", None]), rng.choice(["low", "medium", "high", None]), rng.choice([0.5, None]), origin, rng.randint(1, 3)) for k in rows]
        return rows + [r for r in rows if rng.random() < 0.3]  # repeated rows

    base, override = table("base", 40), table("override", 40)
    merged = {}
    for r in base + override:
        old = merged.get(r[:3])
        merged[r[:3]] = r[3:] if old is None else (*(n if n is not None else o for n, o in zip(r[3:6], old[:3])), old[3], max(old[4], r[7]))
    level = {(k[2], k[0]): v[1] for k, v in merged.items() if k[1] == "severity"}
    rated = lambda k, v: None if None in (k[0], k[2]) else level.get((k[2], k[0]))
    want = [(*k, v[0], rated(k, v) or v[1], *v[2:]) for k, v in merged.items()]
    got = lx.merge_lexicons(*(spark.createDataFrame(t, lx.LEXICON_SCHEMA) for t in (base, override)))
    assert got.columns == lx.LEXICON_SCHEMA.names
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_merged_terms_are_mined_and_moved_once(spark):
    plan = queries.lexicon_merge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # the mined terms and the packaged ones

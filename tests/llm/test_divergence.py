"""Source divergence: the skyband against all pairs, the operator against a plain version, odd rows."""

import collections
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from civiltext.llm import divergence

# -- the skyband ------------------------------------------------------------------------------------


def plain_band(n, c, item, k):
    beaten = (n[None, :] >= n[:, None]) & (c[None, :] <= c[:, None]) & (item[None, :] < item[:, None])
    return set(np.flatnonzero(beaten.sum(1) < k).tolist())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 1500), st.integers(1, 40), st.integers(1, 12))
def test_skyband_holds_those_that_fewer_than_k_dominate(seed, size, spread, k):
    rng = np.random.default_rng(seed)
    n, c, item = rng.integers(1, spread + 1, size), rng.integers(1, spread + 1, size), rng.permutation(size)
    assert set(divergence.skyband(n, c, item, k).tolist()) == plain_band(n, c, item, k)


def test_skybands_of_parts_merge_to_the_skyband_of_all():
    rng = np.random.default_rng(1)
    n, c, item = rng.geometric(0.2, 4000), rng.integers(1, 300, 4000), rng.permutation(4000)
    parts = [of[divergence.skyband(n[of], c[of], item[of], 7)] for of in np.array_split(rng.permutation(4000), 9)]
    left = np.concatenate(parts)
    assert set(left[divergence.skyband(n[left], c[left], item[left], 7)].tolist()) == plain_band(n, c, item, 7)


# -- the operator -----------------------------------------------------------------------------------


def plain_audit(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        in_docs = collections.Counter(w for _, _, ws in mine for w in set(ws))
        kept = sorted((w for w in in_docs if in_docs[w] >= least), key=str.encode)
        counts = {s: collections.Counter(w for _, x, ws in mine if x == s for w in ws if in_docs[w] >= least) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), collections.Counter())
        p = lambda c, w: 1 + (10**9 * (c[w] + 1)) // (c.total() + len(kept))
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in counts.items():
            pairs = [(-sum(f(p(c, w), p(d, w)) for w in kept), o.encode(), o) for o, d in counts.items() if o != s]
            terms = [(-f(p(c, w), p(whole, w)), w.encode(), w) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, **kw):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, value int, term string, rank int")
    return sorted(map(tuple, divergence.source_divergence(table, **kw).collect()))


ODD = [
    ("en", "a", "The cat, the CAT and the dog"), ("en", "a", "the cat sat"), ("en", "b", "THE dog's über-cat 123 über"), ("en", "b", "the über dog"),
    ("en", "b", "the über dog"), ("en", None, "cat über dog the"), ("en", "", "dog"), (None, "a", "the the the"), (None, "a", None), ("", "b", "the"), ("", "c", "the é"),
    ("fr", "a", ""), ("fr", "b", None), ("fr", "c", "12 34 !"), ("de", "solo", "ein ein"), ("de", "solo", "ein"), ("de", "solo", "ein zwei"), ("en", "long", "the cat " * 30_000 + "z" * 200_000),
]


def test_audit_equals_a_plain_version(spark):
    assert audited(spark, ODD) == plain_audit(ODD)
    assert audited(spark, [r for r in ODD if r[0] == "fr"]) == plain_audit([r for r in ODD if r[0] == "fr"])
    assert audited(spark, []) == []


def test_audit_on_random_words_with_few_ranks_and_forced_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "kLmnopqéñü"]
    rows = [("xy"[int(rng.integers(2))], "pqrst"[int(rng.geometric(0.4)) % 5], " ".join(rng.choice(words, 25, p=np.arange(1, 101) / 5050))) for _ in range(120)]
    assert audited(spark, rows, top=5) == plain_audit(rows, top=5)
    assert audited(spark, rows, top=5, least_docs=12) == plain_audit(rows, 12, 5)

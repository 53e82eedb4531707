"""Importance resampling: CRC states against zlib, the draw against a plain version, odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from civiltext.llm import resampling
from civiltext.llm.charruns import LETTERS_DIGITS, lower_runs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def runs(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_states_follow_each_other_as_bytes_do():
    rng = np.random.default_rng(0)
    a = [bytes(rng.integers(0, 256, rng.integers(0, 30), dtype=np.uint8)) for _ in range(300)]
    b = [bytes(rng.integers(0, 256, rng.integers(0, resampling.HEAD_LENGTH + 1), dtype=np.uint8)) for _ in range(300)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert (resampling.followed(crc(a), crc(b), np.array([len(x) for x in b])) == crc([x + y for x, y in zip(a, b)])).all()
    assert (resampling.with_space(crc(a)) == crc([x + b" " for x in a])).all()


@pytest.mark.parametrize("head", [[], ["the"], ["the", "cat", "über", "sat", "1st"], ["the", "cat", "über", "sat", "1st", "on", "mat", "x" * 48]])
@pytest.mark.parametrize("pairs", [1, 3, 1024])
def test_head_and_tail_give_the_same_features(head, pairs, monkeypatch):
    monkeypatch.setattr(resampling, "PAIR_WORDS", pairs)
    texts = ["The cat SAT on the mat, the über-cat!", None, "", "1st", "cat the", "x" * 48 + " the " + "y" * 500 + " über the Ü", "the " * 50, "...", "on\x00mat　sat"]
    got = resampling.features(lower_runs(pa.array(texts), LETTERS_DIGITS), resampling.Head.of(pa.array(head, pa.large_string())))
    for i, t in enumerate(texts):
        at = range(got.rows[i], got.rows[i + 1])
        assert [got.crcs[k][j] for k in range(3) for j in at if got.inside[k][j]] == [zlib.crc32(x.encode()) for x in runs(t)]


def plain_draw(docs, target, percent=5, least=20):
    count = lambda texts: np.bincount([zlib.crc32(f.encode()) % 10_000 for t in texts for f in runs(t)] or [0], minlength=10_000) - (0 if any(runs(t) for t in texts) else np.eye(1, 10_000, dtype=int)[0])
    s, t = count([d[1] for d in docs]).tolist(), count(target).tolist()
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + 10_000) / ((s[k] + 1) * (sum(t) + 10_000)))) for k in range(10_000)]
    rows = []
    for i, text in docs:
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in runs(text))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


ORDER = lambda r: tuple((x is not None, x or 0) for x in r)


def test_draw_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É1", "naïve", "Z" * 60]
    text = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(7, docs[7][1]), (7, "other text " * 15), (None, text(40)), (None, None), (301, ""), (302, None), (303, "word " * 20_000)] + [(400, "same same " * 10)] * 30
    target = [text(20) for _ in range(10)] + [None, ""]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, weight int, rank string")
    want = sorted(plain_draw(docs, target, 30), key=ORDER)
    got = resampling.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert sorted(map(tuple, got.collect()), key=ORDER) == want
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id int, text string")
    assert sorted(map(tuple, resampling.resample(some, none).collect())) == sorted(plain_draw([(1, "a b c"), (2, None)], []))

"""BPE, token counts, token files, quality rules and ranking, sharding: against plain versions, on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from civiltext.llm import bpe, quality_rank, quality_rules, shards, token_counts, tokenfile, wordtable

SCHEMA = "doc_id long, text string, n_tokens int, size string, kept int, ids string"
ODD = [
    None, "", " ", "  a  b", "x<|endoftext|> y <|endoftext|>z", "don't it's we'll  THE ΣΑΣ x y z.　w", "a.b,c!?d 1.5 12,3 \n\n x",
    "\x1c \x1f a \x85 b", " leading", "trailing ", " é à ç é e ́x", "日本語 テスト 👍🏽 x", "tab\tx \t y\r\nz", "...!!! ?? a,b",
    " <|startoftext|> a<|endoftext|>.", " " * 50 + "a" + " " * 3, "#*$%&|<> # a", "same line\nother\nsame line\n\nsame line",
    "one two three one two three four", "word " * 3000, "x" * 50_000, "one two " * 40 + "é" * 300,
]


def odd_rows():
    rows = [(i, t, 1, "s", 2, "i") for i, t in enumerate(ODD)]
    return [*rows, (None, "no id here", 1, None, None, None), (None, None, None, None, None, None), (5, ODD[5], 1, "s", 2, "i"), (5, ODD[5], 1, "s", 2, "i"), (7, "another text", 3, "", 1, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(params=[3, 1 << 20], ids=["few-hot", "all-hot"])
def hot(request, monkeypatch):
    monkeypatch.setattr(wordtable, "HOT_ROWS", request.param)
    return request.param


def plain_ids(tokenizer, text):
    return tuple(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_and_decoding_equal_whole_texts(odd, hot, name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    want = collections.Counter((r[0], plain_ids(tokenizer, r[1])) for r in odd_rows())
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    for r in got:
        assert r.decoded == tokenizer.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_equal_whole_texts(odd, hot, name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    got = token_counts.count_tokens(odd, path, limit=100).collect()
    want = collections.Counter(
        (r[0], len((r[1] or "").encode()), n := len(plain_ids(tokenizer, r[1])), n > 100) for r in odd_rows()
    )
    assert collections.Counter(map(tuple, got)) == want


def test_pieces_cover_every_byte_and_never_cut_a_pre_token():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cut = wordtable.cut_for(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    alphabet = [" ", " ", "a", "B", "é", "1", ".", ",", "'", "s", "\n", "\t", " ", "　", "\x85", "!", "|", "<|endoftext|>", "語", "́"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 40))))
        raw = text.encode()
        found, _ = cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        parts = found.to_pylist()
        assert "".join(parts) == text
        assert sum((list(plain_ids(tokenizer, p)) for p in parts), []) == list(plain_ids(tokenizer, text))


def test_token_files_round_trip(odd, hot):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = sorted(tokenfile.token_file_round_trip(odd, path).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r[0] for r in odd_rows() if r[0] is not None)
    want = collections.Counter((r[0], (*plain_ids(tokenizer, r[1]), 0)) for r in odd_rows())
    at, seen = 0, collections.Counter()
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
        seen[r.doc_id, tuple(ids.tolist())] += 1
    assert seen == want


@pytest.mark.parametrize("seed", range(4))
def test_huffman_codes_are_prefix_free_limited_and_reversible(seed):
    rng = np.random.default_rng(seed)
    counts = np.floor(1e6 / np.arange(1, 3000) ** (seed + 0.7)).astype(np.int64)
    rng.shuffle(counts)
    lengths = tokenfile.code_lengths(counts, 14)
    used = counts > 0
    assert (lengths[used] > 0).all() and (lengths[~used] == 0).all() and lengths.max() <= 14
    assert sum(2.0 ** -lengths[used].astype(float)) <= 1 + 1e-12
    ids = rng.choice(np.flatnonzero(used), 5000).astype(np.uint32)
    codes = tokenfile.canonical_codes(lengths)
    parts = [ids[:1], ids[1:130], ids[130:]]
    blocks = [tokenfile.encode_block(p, lengths, codes) for p in parts]
    back = tokenfile.decode_blocks([b for b, _ in blocks], [m for _, m in blocks], list(map(len, parts)), tokenfile.decoding_table(lengths))
    assert back.tolist() == ids.tolist()


def test_huffman_without_a_limit_in_reach_is_optimal():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((counts * tokenfile.code_lengths(counts)).sum()) == cost


def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_measures(odd):
    got = quality_rules.apply_rules(odd).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter((r.doc_id, *(r[n] for n in names)) for r in got) == collections.Counter((r[0], *plain_measures(r[1])) for r in odd_rows())
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_rules_keep_prose_and_reject_noise(spark):
    prose = " ".join(f"the {w} of {w}er house{i} was{i} number{i} in a{i} long{w} street" for i, w in enumerate("red blue green old new big small dark bright first".split()))
    rows = [(1, prose), (2, re.sub(r"(\w) ", r"\1### ", prose)), (3, prose.upper()), (4, " | ".join(prose.split())), (5, "x " * 80)]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_a_filter_does_not_repeat_the_measures(spark, odd):
    plan = quality_rules.apply_rules(odd).filter("kept").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


def shard_rows(got):
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    return by


def test_shards_on_odd_rows(odd):
    got = shards.assign_shards(odd).collect()
    assert collections.Counter((r.doc_id, r.text, int(r["size"]), r.text_crc32) for r in got) == collections.Counter(
        (r[0], r[1], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows()
    )
    for rows in shard_rows(got).values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))


def test_shards_have_near_equal_bytes_and_split_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " + "y" * int(rng.integers(1, 200))) for i in range(6000)]
    got = shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = shard_rows(got)
    sizes = [sum(r["size"] for r in by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 0.03 * np.mean(sizes)
    for s in range(8):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.text].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 1  # only the group that no shard can hold


def test_splitters_equal_a_sorted_list(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), int(s)) for a, b, s in zip(rng.integers(0, 2**63 - 1, 800), rng.integers(0, 2**63 - 1, 800), rng.integers(1, 50, 800))]
    found = shards.find_splitters(spark.createDataFrame(rows, "k1 long, k2 long, size long"), 4, tolerance=0.0)
    total = sum(r[2] for r in rows)
    for i, x in enumerate(found, 1):
        below = sum(r[2] for r in rows if r[:2] < (x.text_key, x.row_key))
        assert below == x.below and abs(below - total * i / 4) <= 50


def test_ranking_learns_the_preference_and_ignores_the_held_out_fold(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 2
        rows.append((i, (f"the word{i} of that place was in the house " * 8) if good else (f"#### word{i}$$$ || &&& " * 12)))
        wrong = zlib.crc32(str(i).encode()) % 4 == 2  # held-out labels are turned round: they must not matter
        labels.append((i, 1 - good if wrong else good))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_rank.score_quality(docs, marks).collect()
    assert all(r.predicted == r.doc_id % 2 and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_ranking_on_odd_rows_and_labels(spark, odd):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 1), (3, 1, 0), (3, 0, 0), (99, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rank.score_quality(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in quality_rank.score_quality(odd, labels.limit(0)).collect()}) == 1


def test_empty_tables(spark, none):
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert bpe.decode(bpe.encode(none, word), word).collect() == []
    assert token_counts.count_tokens(none, byte).collect() == []
    assert tokenfile.token_file_round_trip(none, byte).collect() == []
    assert quality_rules.apply_rules(none).collect() == []
    assert shards.assign_shards(none).collect() == []
    assert quality_rank.score_quality(none, labels).collect() == []


def test_digest_of_decoded_text(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(odd.filter("doc_id = 9"), path), path).first()
    assert hashlib.sha256(got.decoded.encode()).hexdigest() == hashlib.sha256(tokenizer.decode(list(plain_ids(tokenizer, ODD[9]))).encode()).hexdigest()


def test_ranking_equals_a_plain_descent_on_the_same_preferences():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = (x[:, 0] + rng.normal(size=120) > 0.3).astype(int)
    ranking = quality_rank.fit_ranking(x, y, ["a", "b", "c"])
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    d = np.concatenate([z, z * z], axis=1)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(quality_rank.SEED)
    n = quality_rank.OPPONENTS
    better = np.concatenate([np.repeat(good, n), rng.choice(good, n * len(bad))])
    worse = np.concatenate([rng.choice(bad, n * len(good)), np.repeat(bad, n)])
    w = np.zeros(6)
    for _ in range(3_000):  # plain descent on the mean logistic loss with the ridge
        wrong = 1 / (1 + np.exp((d[better] - d[worse]) @ w))
        w -= 2.0 * (quality_rank.RIDGE * w - ((d[better] - d[worse]) * wrong[:, None]).mean(0))
    assert np.allclose(ranking.weights, w, atol=1e-3)
    raw = np.sort(d @ w)
    assert abs(ranking.cut - (raw[len(bad) - 1] + raw[len(bad)]) / 2) < 1e-2

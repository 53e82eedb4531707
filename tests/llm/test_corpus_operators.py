"""WARC, decontamination, personal data, near duplicates, the pipeline: against plain versions, on odd rows."""

import collections
import hashlib
import io
import itertools
import re

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from civiltext.llm import decontam, neardup, pii, warc
from civiltext.llm.components import components

# -- WARC -----------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/", "long page " * 30), (2, "http://b/", "long page " * 30), (0, "http://c/\r\nX: y", "long page " * 30), (3, None, None), (4, "", ""),
    (5, "u", "short"), (6, "u", "short"), (None, "u", "long page " * 30), (None, "n", "only without id " * 20), (7, "ü", "é" * 60), (8, "ü", "é" * 60),
    (9, "x", "big \r\n\r\n " * 60_000), (0, "http://again/", "long page " * 30), (10, "y", "a\r\n\r\nb"),
]


def plain_pages():
    payloads = [(i, (h or "").encode()) for i, _, h in PAGES]
    for i, p in payloads:
        first = min((j for j, q in payloads if q == p and j is not None), default=None)
        revisit = len(p) >= 100 and first is not None and i != first
        yield i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    pages = spark.createDataFrame([(*p, 0, "x") for p in PAGES], "page_id long, url string, html string, payload_bytes int, digest string")
    listed = warc.write_archives(pages, str(tmp_path / "archives"))
    got = warc.read_archives(listed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_pages())
    assert listed.count() > 1


def test_archive_begins_with_its_dictionary_and_has_a_frame_for_each_record():
    dictionary = b"WARC/1.1 response text/html " * 20
    context = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    records = [warc.record_bytes(i, "u", b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None, False) for i in range(5)]
    raw = warc.dictionary_frame(dictionary) + b"".join(map(context.compress, records))
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    # the dictionary may be compressed itself
    packed = warc.dictionary_frame(zstandard.ZstdCompressor().compress(dictionary)) + b"".join(map(context.compress, records))
    assert list(warc.read_archive(io.BytesIO(packed))) == records
    for bad in (raw[:-3], raw[10:], b"", raw[:6]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))


def test_faulty_records_are_refused():
    good = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    assert warc.page_of(warc.parse_record(good))[1] == 7
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: ", b"Content-Length: 1"), good[:-1], good.replace(b"WARC-Date", b"X-Date"),
        good.replace(b"WARC-Type: response", b"WARC-Type response"), good.replace(b"payload\r\n", b"payloaX\r\n"), b"", good.replace(b"WARC-Type: response", b"WARC-Type: odd"),
    ):
        with pytest.raises(ValueError):
            warc.page_of(warc.parse_record(bad))


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# -- decontamination ------------------------------------------------------------------------------


def plain_distance(item, text):
    """The least edit distance of the item to any part of the text, and the first end of such a part."""
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, d in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (d != c)))
        row = new
        best = min(best, (row[-1], j), key=lambda x: x[0])
    return best


def test_bit_parallel_distance_equals_the_table():
    rng = np.random.default_rng(3)
    for _ in range(300):
        item = "".join(rng.choice(list("abc "), int(rng.integers(1, 90))))
        text = "".join(rng.choice(list("abc "), int(rng.integers(0, 120))))
        if rng.random() < 0.5:
            text = text[:20] + item[: len(item) // 2] + "x" + item[len(item) // 2 :] + text[20:]
        want = plain_distance(item, text)
        assert decontam.best_end(decontam.masks_of(item), len(item), text, len(item)) == (want if want[1] else None) or want[0] == len(item)


def edited(rng, text, k):
    chars = list(text)
    for _ in range(k):
        at = int(rng.integers(len(chars)))
        chars[at : at + 1] = [[], ["q"], [chars[at], "q"]][int(rng.integers(3))]
    return "".join(chars)


def test_every_item_within_its_budget_is_found_and_no_other(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8))))
    sentence = lambda n: " ".join(word() for _ in range(n))
    items = [(i, sentence(30)) for i in range(8)] + [(8, None), (9, " "), (10, "")]
    docs, k_of = [], {i: decontam.budget_of(decontam.normal(t)) for i, t in items[:8]}
    for n in range(60):
        i = n % 8
        docs.append((n, sentence(20) + " " + edited(rng, items[i][1], int(rng.integers(0, 2 * k_of[i]))) + " " + sentence(20)))
    docs += [(60, None), (61, ""), (62, items[0][1].upper().replace(" ", ",  ")), (62, items[0][1]), (None, items[1][1]), (63, sentence(3000))]
    docs_df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, distance int, item_id int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontam.contaminations(docs_df, bench).collect()
    want = collections.Counter()
    for d, t in docs:
        for i, item in items[:8]:
            p, q = decontam.normal(item), decontam.normal(t or "")
            distance, end = plain_distance(p, q)
            if distance <= k_of[i]:
                want[d, i, distance, end] += 1
    assert collections.Counter((r.doc_id, r.item_id, r.distance, r.match_end) for r in got) == want
    assert sum(r.distance > 0 for r in got) > 5
    clean = decontam.without_contaminated(docs_df, bench)
    assert clean.columns == docs_df.columns
    hit = {(r.doc_id) for r in got}
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter(d for d, _ in docs if d not in hit)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"this is the item number {i} with some more words in it") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before this is the item number {i % 7} with some more words in it after") for i in range(20)], "doc_id long, text string")
    one = sorted(map(tuple, decontam.contaminations(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1)
    assert sorted(map(tuple, decontam.contaminations(docs, bench).select("doc_id", "item_id", "distance", "budget", "match_start", "match_end").collect())) == one


def test_no_documents_or_items(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert decontam.contaminations(docs, bench).collect() == [] == decontam.contaminations(some, bench).collect()
    assert decontam.without_contaminated(some, bench).count() == 1


# -- personal data --------------------------------------------------------------------------------

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(5)
    parts = ["a", "b.c", "@", "@x.y", "1", "23", "255", "256", "007", ".", ".", "-", " ", "+", "+1", "(", ")", "é", "_", "%", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 16))))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_cost_little():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 150_000, "+1" + "(" * 100_000):
        pii.base_spans(text)


def test_the_field_scores_cuts_exactly():
    """Forward and backward sums and the best cut against all cuts of a short stretch."""
    rng = np.random.default_rng(6)
    x = pii.lattice("a 12 b@c.d 3")
    field = pii.Field(rng.normal(size=(pii.ROWS, len(pii.KINDS))), rng.normal(size=(len(pii.KINDS) + 1,) * 2))
    score, n, outside = field.scores(x), len(x.spans), len(pii.KINDS)
    starts = collections.defaultdict(list)
    for s, (b, e) in enumerate(zip(x.begin.tolist(), x.end.tolist())):
        starts[b].append((s, e))

    def cuts(t, last):
        if t == n:
            yield 0.0, ()
            return
        for rest, cut in cuts(t + 1, outside):
            yield field.joins[last, outside] + rest, cut
        for s, e in starts[t]:
            for k in range(outside):
                for rest, cut in cuts(e, k):
                    yield field.joins[last, k] + score[s, k] + rest, ((t, e, k), *cut)

    every = list(cuts(0, outside))
    total = np.logaddexp.reduce([v for v, _ in every])
    alpha, _ = field.forward(x, score)
    assert np.isclose(np.logaddexp.reduce(alpha[-1]), total)
    assert np.isclose(field.backward(x, score)[0, -1], total)
    assert tuple(field.best(x)) == max(every, key=lambda v: v[0])[1]


@pytest.fixture(scope="module")
def personal(spark):
    rows = [
        (1, "Write to jo.doe@mail.example.com or +1 (743) 555-3824 now"), (2, "host 10.20.30.40 and card 4111 1111 1111 1111 there"), (3, None), (4, ""),
        (5, 'set token = "b44e15e09fd311c3cf3163b66d5a9875b8aabbcc" here'), (6, "call (743) 555-3824 today, item 12 costs 3.50 in 2024"), (None, "a@b.co"),
        (7, "nothing to see"), (1, "Write to jo.doe@mail.example.com or +1 (743) 555-3824 now"), (8, "x" * 40_000 + " 1.1.1.1"),
    ]
    return spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, spans string")


def test_spans_of_documents(personal):
    got = pii.find_spans(personal).collect()
    assert len(got) == personal.count()
    texts = collections.defaultdict(list)
    for r in personal.collect():
        texts[r.doc_id].append(r.text or "")
    for r in got:
        base = plain_spans(texts[r.doc_id][0])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE_KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    by = {r.doc_id: r.spans for r in got}
    assert by[5] == "secret:13:53" and by[6] == "phone:5:19" and by[7] == "" and by[3] == ""


def test_masking(personal):
    got = {r.doc_id: r.text for r in pii.mask_spans(personal).collect()}
    assert got[1] == "Write to [EMAIL] or [PHONE] now" and got[2] == "host [IP] and card [CARD] there"
    assert got[3] is None and got[4] == "" and got[7] == "nothing to see" and got[None] == "[EMAIL]"
    assert pii.mask_spans(personal).columns == personal.columns
    assert pii.mask_spans(personal.limit(0)).collect() == [] == pii.find_spans(personal.limit(0)).collect()


# -- near duplicates ------------------------------------------------------------------------------


def plain_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[max(top(i), top(j))] = min(top(i), top(j))
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        component = d if not sets[i] else min(least[top(i)], default=None)
        out.append((d, len(sets[i]), component, component == d))
    return out


def corpus(rng, n):
    word = lambda: "".join(rng.choice(list("abcdefgh"), 3))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for g in range(n):
        base = [word() for _ in range(int(rng.integers(1, 120)))]
        for _ in range(int(rng.choice([1, 1, 1, 2, 3, 25]))):
            w = list(base)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(len(w)))] = word()
            text = " ".join(w)
            if rng.random() < 0.3:
                text = f"{passage}\n{text}"
            rows.append(text.upper() if rng.random() < 0.1 else text)
    return rows


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 85, 1), (5, 80, 2), (3, 85, 3)])
def test_components_equal_all_pairs(spark, size, percent, seed):
    rng = np.random.default_rng(seed)
    texts = corpus(rng, 60) + ["", None, " \t", "one", "ONE", "one two", "É", "é"]
    ids = rng.permutation(10 * len(texts))[: len(texts)].tolist()
    rows = [*zip(ids, texts), (None, texts[0]), (None, "alone without id here"), (ids[1], texts[1]), (ids[2], texts[3])]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, keys string, n_shingles int").repartition(4)
    got = neardup.near_duplicates(docs, linking=neardup.Linking(size, percent)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_components(rows, size, percent))


def test_blocks_of_a_large_group(spark, monkeypatch):
    """Many near copies around the threshold, with blocks so small that every kind of block pair occurs."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(int(rng.integers(0, 12))):
            w[int(rng.integers(len(w)))] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), linking=neardup.Linking(3, 85)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_components(rows, 3, 85))


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text), (2, text), (2, text), (5, text + " more"), (9, "other words are here today"), (7, None), (8, ""), (8, ""), (None, "null id text is here")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, root string")
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter([2, 9, 7, 8, 8, None])
    assert neardup.keep_one(docs.limit(0)).collect() == []


def test_least_matches_follow_the_binomial():
    t = neardup.least_matches(48, 0.85)
    chance = lambda t: sum(np.exp(_log_binomial(48, i, 0.85)) for i in range(t))
    assert chance(t) <= neardup.MISS < chance(t + 1)


def _log_binomial(n, i, p):
    from math import lgamma, log

    return lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (202, 202)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version of its own decision, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "pii_masking", "bpe"]
    kept = stages["quality_rules"](spark, docs, sf)
    rows = kept.collect()
    assert kept.columns == docs.columns and 0 < len(rows) < docs.count()
    assert all(len((r.text or "").split()) >= 50 for r in rows)
    single = stages["near_dedup"](spark, kept, sf).collect()
    want = {c for _, n, c, k in plain_components([(r.doc_id, r.text) for r in rows], 5, 80)}
    assert {r.doc_id for r in single} == want and len(single) == len(want)
    single_df = spark.createDataFrame(single, docs.schema)
    clean = stages["decontamination"](spark, single_df, sf).collect()
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not any(i in decontam.normal(r.text) for i in items)}
    masked = stages["pii_masking"](spark, spark.createDataFrame(clean, docs.schema), sf).collect()
    assert len(masked) == len(clean) and all(not plain_spans(r.text) and r.n_chars == len(r.text) for r in masked)
    coded = stages["bpe"](spark, spark.createDataFrame(masked, docs.schema), sf).collect()
    assert {r.doc_id for r in coded} == {r.doc_id for r in masked}


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

"""Importance resampling towards a target: documents drawn by how much their hashed n-grams look like the target's.

Features are all runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo
``BUCKETS``. Counting them never builds the features:

* **Head.** All words are counted exactly. The most frequent ones go to every task with their CRC states
  (the CRC of the word and of the word with a space), together with a square table of the CRCs of all
  pairs of the ``PAIR_WORDS`` most frequent. The CRC of a longer run follows from the states: advancing a
  state over n bytes is a linear map, four table reads for each n.
* **Tail.** A feature with a word outside the head gets its CRC from its bytes.

Both ways give the same number, so the size of the head decides the speed alone. Totals of all buckets
are exact sums over tasks (``BUCKETS`` rows). Drawing takes the highest scores by an order-statistic index,
without one sorted task.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.llm.arrowtext import slices, tidied
from civiltext.llm.charruns import LETTERS_DIGITS, Runs, lower_runs
from civiltext.operators.ordered import page_index
from civiltext.sources.storage import materialise, temporary

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Frequent words that go to every task: at most so many, of at most ``HEAD_BYTES`` together (16 bytes of states besides).
HEAD_WORDS = 1 << 17
HEAD_BYTES = 4 << 20
#: Longer words are tail words, so the advance tables end here.
HEAD_LENGTH = 48
#: Words whose pairs have a table: 4 MB.
PAIR_WORDS = 1 << 10
#: Steps of the histogram of word counts for each doubling.
LOG_STEPS = 32

U32 = np.uint32


# -- CRC states ------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    """What a byte adds to a state: the CRC polynomial divided by all bytes."""
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = np.where(t & 1, (t >> U32(1)) ^ U32(0xEDB88320), t >> U32(1)).astype(U32)
    return t


@functools.lru_cache(maxsize=1)
def advance_tables() -> np.ndarray:
    """[n * 1024 + 256 * k + b]: byte b at place k of a CRC after n further zero bytes."""
    out = np.empty((HEAD_LENGTH + 2, 4, 256), U32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=U32) << U32(8 * k)
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> U32(8)) ^ crc_table()[out[n - 1] & U32(255)]
    return out.reshape(-1)


def followed(crc: np.ndarray, then: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of A + B from those of A and B and the bytes of B."""
    tables, base = advance_tables(), length.astype(np.int64) << 10
    out = tables[base + (crc & U32(255))]
    for k in (1, 2, 3):
        out ^= tables[base + (256 * k) + ((crc >> U32(8 * k)) & U32(255))]
    return out ^ then


def with_space(crc: np.ndarray) -> np.ndarray:
    """CRCs of A + ' ' from those of A."""
    state = ~crc
    return ~((state >> U32(8)) ^ crc_table()[(state ^ U32(32)) & U32(255)])


@dataclass
class Head:
    """The frequent words, the most frequent first, with their states; ``pairs[i, j]`` is the CRC of words i and j with a space."""

    words: pa.Array
    crc: np.ndarray
    spaced: np.ndarray
    length: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Head:
        raw = words.cast(pa.large_binary()).to_pylist()
        crc = np.array([zlib.crc32(w) for w in raw], U32)
        length = np.array([len(w) for w in raw], np.int64)
        spaced = with_space(crc)
        m = min(PAIR_WORDS, len(raw))
        pairs = followed(np.repeat(spaced[:m], m), np.tile(crc[:m], m), np.tile(length[:m], m)).reshape(m, m)
        return cls(words, crc, spaced, length, pairs)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counted = pc.value_counts(lower_runs(part.column("text"), LETTERS_DIGITS).strings)
            yield pa.record_batch({"word": counted.field("values").cast(pa.string()), "n": counted.field("counts")})

    return texts.mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_head(texts: DataFrame) -> Head:
    """The most frequent words of all texts, from a histogram of their exact counts; only they reach the driver."""
    with temporary(word_counts(texts), "resampling-words") as counts:
        short = counts.filter(F.octet_length("word") <= HEAD_LENGTH)
        level = F.floor(F.log2(F.col("n").cast("double")) * LOG_STEPS)
        steps = short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("word")).alias("b")).collect()
        rows, size, least = 0, 0, None
        for r in sorted(steps, key=lambda r: -r["level"]):
            rows, size = rows + r["k"], size + r["b"]
            if rows > HEAD_WORDS or size > HEAD_BYTES:
                break
            least = int(r["level"])
        found = short.filter(level >= least if least is not None else F.lit(False)).toArrow()
    return Head.of(found.sort_by([("n", "descending"), ("word", "ascending")]).column("word").combine_chunks().cast(pa.large_string()))


# -- features ----------------------------------------------------------------------------------------


@dataclass
class Features:
    """CRCs of the runs of 1, 2 and 3 words that begin at each word, and which of them are inside the word's text."""

    crcs: list[np.ndarray]
    inside: list[np.ndarray]
    rows: np.ndarray

    def buckets(self, n: int) -> np.ndarray:
        return (self.crcs[n] % U32(BUCKETS)).astype(np.int64)


def features(found: Runs, head: Head) -> Features:
    """Features of a slice: from the head's states where all words are in it, else from their bytes."""
    coded = found.strings.dictionary_encode()
    own, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # the other way round: a hash table of the slice's few words, not of the whole head
    back = pc.index_in(head.words, value_set=own)
    known = pc.indices_nonzero(pc.is_valid(back)).to_numpy().astype(np.int64)
    place = np.full(len(own) + 1, -1, np.int64)
    place[back.drop_null().to_numpy()] = known
    w = place[codes]
    n = len(w)
    last = np.repeat(found.rows[1:], np.diff(found.rows))
    inside = [np.arange(n) + k < last for k in range(LONGEST_RUN)]
    crcs = [np.zeros(n, U32) for _ in range(LONGEST_RUN)]
    seen = w >= 0
    one = np.flatnonzero(seen)
    crcs[0][one] = head.crc[w[one]]
    done = [seen]
    if n > 1:
        both = seen[:-1] & seen[1:] & inside[1][:-1]
        top = len(head.pairs)
        frequent = both & (w[:-1] < top) & (w[1:] < top)
        a = np.flatnonzero(frequent)
        crcs[1][a] = head.pairs[w[a], w[a + 1]]
        b = np.flatnonzero(both & ~frequent)
        crcs[1][b] = followed(head.spaced[w[b]], head.crc[w[b + 1]], head.length[w[b + 1]])
        done.append(np.append(both, False))
        three = np.flatnonzero(both[:-1] & seen[2:] & inside[2][:-2])
        crcs[2][three] = followed(with_space(crcs[1][three]), head.crc[w[three + 2]], head.length[w[three + 2]])
        done.append(np.zeros(n, bool))
        done[2][three] = True
    _tail(found, crcs, inside, done)
    return Features(crcs, inside, found.rows)


def _tail(found: Runs, crcs: list[np.ndarray], inside: list[np.ndarray], done: list[np.ndarray]) -> None:
    """CRCs of the features with a word outside the head, from their bytes with one space between words."""
    n = len(found.at) - 1
    spaced = np.full(len(found.data) + n, 32, np.uint8)
    spaced[np.arange(len(found.data)) + np.repeat(np.arange(n), np.diff(found.at))] = found.data
    raw, begin = memoryview(spaced.tobytes()), found.at[:-1] + np.arange(n)
    end = begin + np.diff(found.at)
    for k in range(min(LONGEST_RUN, len(done))):
        rest = np.flatnonzero(inside[k] & ~done[k])
        crcs[k][rest] = [zlib.crc32(raw[a:b]) for a, b in zip(begin[rest].tolist(), end[rest + k].tolist())]


def bucket_totals(texts: DataFrame, head) -> np.ndarray:
    """Features of all texts in every bucket; a task gives one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(batches, "text"):
            f = features(lower_runs(part.column("text"), LETTERS_DIGITS), head.value)
            for k in range(LONGEST_RUN):
                total += np.bincount(f.buckets(k)[f.inside[k]], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    rows = texts.mapInArrow(tidied(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def bucket_gains(ours: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of every bucket."""
    all_ours, all_target = int(ours.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1) * (all_ours + BUCKETS) / ((s + 1) * (all_target + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(ours.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, head, gains) -> DataFrame:
    """(id, n_words, n_features, weight) of (id, text) rows."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            f = features(lower_runs(part.column("text"), LETTERS_DIGITS), head.value)
            sums = np.zeros(len(f.crcs[0]) + 1, np.int64)
            number = np.zeros(len(sums), np.int64)
            for k in range(LONGEST_RUN):
                sums[1:] += np.where(f.inside[k], gains.value[f.buckets(k)], 0)
                number[1:] += f.inside[k]
            per_row = lambda x: pa.array(np.diff(np.cumsum(x)[f.rows]))
            yield pa.record_batch({"id": part.column("id"), "n_words": pa.array(np.diff(f.rows).astype(np.int64)), "n_features": per_row(number), "weight": per_row(sums)})

    return docs.mapInArrow(tidied(weigh), f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(row_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 of 'seed:id'; a null id counts as ''."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``.

    Of the rows with at least ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn: those
    with the highest scores, the smaller id first among equal ones (a null id is the smallest). ``rank`` counts
    the drawn rows from 1 and is null for others.

    Null and empty texts have no words, no features and the weight 0. Rows with equal ids are rows of their
    own. Without target texts every bucket counts as seen no more than the smoothing says. An empty
    table gives an empty result; other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    head = context.broadcast(learn_head(plain.select("text")))
    ours = bucket_totals(plain.select("text"), head)
    theirs = bucket_totals(target.select(F.col(target_text).cast("string").alias("text")), head)
    gains = context.broadcast(bucket_gains(ours, theirs))
    scored = materialise(weighed(plain, head, gains).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "resampling-scores")
    able = F.col("n_words") >= least_words
    draw = percent * scored.filter(able).count() // 100
    ordered = page_index(scored.filter(able), [F.desc("score"), F.asc("id")], name="resampling-order").numbered("rank")
    ranked = ordered.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    every = ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

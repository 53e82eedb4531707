"""The table of distinct text pieces, and documents written as references into it.

A tokenizer never merges over certain boundaries, so a text may be cut there and each
distinct piece handled once. Two ways to cut:

``words``   runs without ASCII white space, for tokenizers that drop white space;
``pieces``  the text cut before a single space between two other characters, and before
            one of ``. , ; : ! ?`` after an ASCII letter or digit, for byte-level
            tokenizers, which attach one leading space to what follows. Pieces cover every
            byte. Characters of an added token are never cut at.

How it scales. Counts of distinct pieces are summed per slice before the shuffle. The most
frequent pieces, at most ``HOT_ROWS`` and ``HOT_BYTES`` together, are given to every task; all
others, which are rare by construction, are joined on the piece. The limit only decides which
way a piece goes, never whether it is handled. Documents move once, as compressed piece
numbers, and never as text.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.llm.arrowtext import buffers, joined, slices, tidied, words
from civiltext.sources.storage import materialise, temporary

HOT_ROWS = 1 << 20
HOT_BYTES = 32 << 20
#: A longer piece is never in the table of the frequent ones, however frequent. Joins deal it out over ``SALTS`` tasks
#: (``encoded_postings``, ``long_salt``); the token files encode it where it stands.
HOT_LENGTH = 4096
SALTS = 64
#: Distinct pieces that are encoded in one call.
ENCODE_ROWS = 20_000
#: Steps of the count histogram for each doubling.
LOG_STEPS = 32

#: The last bytes of white space characters outside ASCII, by their lead bytes (the Unicode list).
WIDE_SPACES = (
    b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(bytes([0xE2, 0x80, x]) for x in range(0x80, 0x8B)),
    b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80",
)


@dataclass(frozen=True)
class Cut:
    """How texts are cut: ``words`` or ``pieces``; ``breaks`` are the bytes before which a piece may end."""

    kind: str
    breaks: bytes = b""

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        return words(data, offsets) if self.kind == "words" else pieces(data, offsets, self.breaks)


def cut_for(path: str) -> Cut:
    """``pieces`` for a byte-level tokenizer that keeps white space, else ``words``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel":
        used = "".join(t["content"] for t in spec["added_tokens"])
        return Cut("pieces", bytes(b for b in b".,;:!?" if chr(b) not in used))
    return Cut("words")


def wide_space_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: does white space outside ASCII begin here, does it end here."""
    begins, ends = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if not (data >= 0x80).any():
        return begins, ends
    for lead in {w[0] for w in WIDE_SPACES}:
        at = np.flatnonzero(data == lead)
        for w in (w for w in WIDE_SPACES if w[0] == lead):
            here = at[at + len(w) <= len(data)]
            for i, b in enumerate(w[1:], 1):
                here = here[data[here + i] == b]
            begins[here] = True
            ends[here + len(w) - 1] = True
    return begins, ends


def pieces(data: np.ndarray, offsets: np.ndarray, breaks: bytes = b".,;:!?") -> tuple[pa.Array, np.ndarray]:
    """Cut where no pre-token of a byte-level tokenizer can go on; see the module's text.

    A space is a place to cut if the characters on both sides are no white space and no
    control characters (those that some libraries take for white space).
    """
    n = len(data)
    solid = data > 0x20
    solid &= data != 0x7F
    begins, ends = wide_space_marks(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        space = data[1:-1] == 0x20
        cut[1 : n - 1] = space & solid[:-2] & ~ends[:-2] & solid[2:] & ~begins[2:]
    if n > 1 and breaks:
        plain = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) | (data >= 48) & (data <= 57)
        stop = np.zeros(256, bool)
        stop[list(breaks)] = True
        cut[1:n] |= stop[data[1:]] & plain[:-1]
    cut[offsets] = True
    bounds = np.flatnonzero(cut)
    if n == 0:
        bounds = np.zeros(1, np.int64)
    return joined(data, bounds), np.searchsorted(bounds, offsets)


# -- the distinct table ------------------------------------------------------------------------


def distinct_pieces(docs: DataFrame, text: str, cut: Cut) -> DataFrame:
    """(piece, n): every piece of all texts with its number of occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found, _ = cut(*buffers(part.column("text")))
            counted = pc.value_counts(found)
            yield pa.record_batch({"piece": counted.field("values").cast(pa.string()), "n": counted.field("counts")})

    partial = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tidied(count), "piece string, n long")
    return partial.groupBy("piece").agg(F.sum("n").alias("n"))


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def id_type_of(path: str) -> str:
    """The numpy type that ids of a tokenizer are stored in inside tables."""
    return "<u2" if vocabulary_size(path) <= 1 << 16 else "<u4"


@functools.lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    """One more than the largest id, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0)


def encoded_pieces(table: DataFrame, path: str, lengths_only: bool = False) -> DataFrame:
    """Each distinct piece encoded once: (piece, n, ids), ids as integers of ``id_type_of``,
    or (piece, n, n_tokens) where only lengths are asked for."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, kind = load_tokenizer(path), id_type_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                coded = tokenizer.encode_batch_fast(part.column("piece").to_pylist(), add_special_tokens=False)
                if lengths_only:
                    last = pa.array([len(c) for c in coded], pa.int64())
                else:
                    last = pa.array([np.array(c.ids, kind).tobytes() for c in coded], pa.binary())
                yield pa.record_batch({"piece": part.column("piece"), "n": part.column("n"), "out": last})

    kind = "n_tokens long" if lengths_only else "ids binary"
    name = kind.split()[0]
    return table.mapInArrow(tidied(encode, load_tokenizer), f"piece string, n long, out {kind.split()[1]}").withColumnRenamed("out", name)


def piece_table(docs: DataFrame, text: str, path: str, lengths_only: bool = False) -> DataFrame:
    """The written table of all distinct pieces with their codes."""
    table = encoded_pieces(distinct_pieces(docs, text, cut_for(path)), path, lengths_only)
    return materialise(table, "pieces")


def is_hot(counts: DataFrame) -> Column:
    """Which rows of a table with (piece, n) are the most frequent pieces.

    A histogram of the counts (its size is bounded by the logarithm of the largest) gives the count
    from which on all pieces of at most ``HOT_LENGTH`` bytes fit into ``HOT_ROWS`` and ``HOT_BYTES``.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * LOG_STEPS)
    short = F.octet_length("piece") <= HOT_LENGTH
    grouped = counts.filter(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("piece")).alias("b"))
    rows, size, least = 0, 0, None
    for r in sorted(grouped.collect(), key=lambda r: -r["level"]):
        rows, size = rows + r["k"], size + r["b"]
        if rows > HOT_ROWS or size > HOT_BYTES:
            break
        least = int(r["level"])
    return short & (level >= least) if least is not None else F.lit(False)


def fetched(hot: DataFrame) -> pa.Table:
    """The frequent pieces on the driver (their number and bytes are bounded), the most frequent first."""
    return hot.toArrow().sort_by([("n", "descending"), ("piece", "ascending")])


def split_table(table: DataFrame) -> tuple[pa.Table, DataFrame]:
    """(the most frequent pieces, the table of the rest)."""
    hot = is_hot(table)
    return fetched(table.filter(hot)), table.filter(~hot)


def hot_ids(docs: DataFrame, text: str, path: str) -> pa.Table:
    """The most frequent pieces of all texts with their ids; all pieces are counted, the rest isn't kept."""
    with temporary(distinct_pieces(docs, text, cut_for(path)), "piece-counts") as counts:
        return fetched(encoded_pieces(counts.filter(is_hot(counts)), path))


def long_salt(key: str = "key") -> Column:
    """The salt that a posting of a very long piece takes from its document; 0 for all other pieces."""
    return F.when(F.octet_length("piece") > HOT_LENGTH, F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(0).cast("int")


def with_long_salts(table: DataFrame) -> DataFrame:
    """A table of distinct pieces with a column ``salt``: one row for each salt that ``long_salt`` may give."""
    every = F.array(*[F.lit(i) for i in range(SALTS)])
    return table.select("*", F.explode(F.when(F.octet_length("piece") > HOT_LENGTH, every).otherwise(F.array(F.lit(0)))).alias("salt"))


def encoded_postings(missing: DataFrame, path: str) -> DataFrame:
    """(key, k, ids) of (key, k, piece) rows: the distinct pieces with the places where they occur, each
    encoded once, and the ids handed back to the places. A piece outside the hot table has few places;
    very long ones, which may have many, are dealt out over ``SALTS`` rows."""
    places = missing.groupBy("piece", long_salt().alias("salt")).agg(F.collect_set(F.struct("key", "k")).alias("places"))
    place_type = places.schema["places"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, kind = load_tokenizer(path), id_type_of(path)
        for batch in batches:
            coded = tokenizer.encode_batch_fast(batch.column("piece").to_pylist(), add_special_tokens=False)
            yield pa.record_batch({"ids": pa.array([np.array(c.ids, kind).tobytes() for c in coded], pa.binary()), "places": batch.column("places")})

    coded = places.select("piece", "places").mapInArrow(tidied(encode, load_tokenizer), f"ids binary, places {place_type}")
    return coded.select("ids", F.explode("places").alias("p")).select("p.key", "p.k", "ids")


def row_key(ids: pa.Array, texts: list[bytes]) -> list[bytes]:
    """A short key for each row, from its id and its whole text: the same in every attempt of a task.

    A whole number gives 8 bytes of its own and 4 of the text's hash (rows with equal ids are few);
    any other id gives 16 bytes of a hash of both.
    """
    out = []
    for i, t in zip(ids.to_pylist(), texts):
        if isinstance(i, int) and -(2**63) <= i < 2**63:
            out.append(i.to_bytes(8, "big", signed=True) + xxhash.xxh32_digest(t))
        else:
            out.append(xxhash.xxh3_128_digest(repr(i).encode() + b"\0" + t))
    return out


def row_bytes(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


@dataclass
class Looked:
    """A slice of documents as numbers of hot pieces; a number from ``hot`` on stands for the row's own list of other pieces."""

    keys: list[bytes]
    numbers: np.ndarray  # of every piece: its place in the hot table, or -1
    rows: np.ndarray  # each document's range in numbers
    own: pa.Array  # distinct pieces of the slice
    codes: np.ndarray  # of every piece: its place in own


def look_up(part: pa.RecordBatch, cut: Cut, hot: pa.Array) -> Looked:
    data, offsets = buffers(part.column("text"))
    found, rows = cut(data, offsets)
    coded = found.dictionary_encode()
    own = coded.dictionary
    # the other way round: a hash table of the slice's few pieces, not of all hot ones
    back = pc.index_in(hot, value_set=own)
    known = pc.indices_nonzero(pc.is_valid(back)).to_numpy()
    at = np.full(len(own), -1, np.int64)
    at[back.drop_null().to_numpy()] = known
    codes = coded.indices.to_numpy(zero_copy_only=False)
    numbers = at[codes] if len(codes) else np.zeros(0, np.int64)
    return Looked(row_key(part.column("id"), row_bytes(data, offsets)), numbers, rows, own, codes)


@dataclass
class Missing:
    """The pieces of a slice that are not in the hot table, once for each document."""

    row: np.ndarray  # the document
    k: np.ndarray  # its number in the document, by first occurrence
    piece: np.ndarray  # its place in the slice's own table
    times: np.ndarray  # how often it occurs in the document
    at: np.ndarray  # every occurrence: its place in the slice
    k_at: np.ndarray  # and its number


def missing_of(seen: Looked) -> Missing:
    """Distinct missing pieces by document. The numbering depends on the document alone, not on its slice."""
    at = np.flatnonzero(seen.numbers < 0)
    doc = np.searchsorted(seen.rows, at, "right") - 1
    width = len(seen.own) + 1
    distinct, first, back, times = np.unique(doc * width + seen.codes[at], return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first, kind="stable")  # by document, then by first occurrence
    row = distinct[order] // width
    k = np.arange(len(order)) - np.searchsorted(row, row)
    number = np.empty(len(order), np.int64)
    number[order] = k
    return Missing(row, k, distinct[order] % width, times[order], at, number[back])


def named(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))


def missing_pieces(docs: DataFrame, id_col: str, text: str, cut: Cut, hot) -> DataFrame:
    """(id, key, k, times, piece): for each document the distinct pieces that are not in the hot table.

    The numbering k follows the first occurrences, so it is the same wherever the document is cut again.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def miss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = hot.value
        for part in slices(batches, "text"):
            seen = look_up(part, cut, values)
            found = missing_of(seen)
            if len(found.row):
                row = pa.array(found.row)
                yield pa.record_batch(
                    {
                        "id": part.column("id").take(row), "key": pa.array(seen.keys, pa.binary()).take(row), "k": pa.array(found.k, pa.int32()),
                        "times": pa.array(found.times, pa.int64()), "piece": seen.own.take(pa.array(found.piece)).cast(pa.string()),
                    }
                )

    return named(docs, id_col, text).mapInArrow(tidied(miss), f"id {id_type}, key binary, k int, times long, piece string")


def pack(numbers: np.ndarray) -> bytes:
    """Piece numbers as four compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").reshape(-1)


def coded_documents(docs: DataFrame, id_col: str, text: str, cut: Cut, hot) -> DataFrame:
    """(id, key, n, coded): each document as packed piece numbers; the k-th missing piece is hot rows + k."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = hot.value
        top = len(values)
        for part in slices(batches, "text"):
            seen = look_up(part, cut, values)
            numbers = seen.numbers.astype(np.int64)
            found = missing_of(seen)
            numbers[found.at] = top + found.k_at
            spans = list(zip(seen.rows[:-1].tolist(), seen.rows[1:].tolist()))
            yield pa.record_batch(
                {
                    "id": part.column("id"), "key": pa.array(seen.keys, pa.binary()),
                    "n": pa.array([b - a for a, b in spans], pa.int32()),
                    "coded": pa.array([pack(numbers[a:b]) for a, b in spans], pa.binary()),
                }
            )

    return named(docs, id_col, text).mapInArrow(tidied(code), f"id {id_type}, key binary, n int, coded binary")


def flat_ids(found: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the hot pieces behind one another, and each piece's range."""
    parts = found.column("ids").to_pylist()
    sizes = np.array([len(x) for x in parts], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def hot_values(found: pa.Table) -> pa.Array:
    return found.column("piece").combine_chunks().cast(pa.large_string())


def resolve(numbers: np.ndarray, hot_ids: np.ndarray, hot_at: np.ndarray, own: list[bytes]) -> np.ndarray:
    """Ids of one document from its piece numbers, the hot table's ids and those of its own pieces."""
    top = len(hot_at) - 1
    start, size = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
    common = numbers < top
    near = numbers[common].astype(np.int64)
    start[common], size[common] = hot_at[near], hot_at[near + 1] - hot_at[near]
    pool = hot_ids
    if not common.all():
        parts = [np.frombuffer(x, pool.dtype) for x in own]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        far = (numbers[~common] - top).astype(np.int64)
        start[~common], size[~common] = at[far], at[far + 1] - at[far]
        rest = np.concatenate(parts)
    ends = np.cumsum(size)
    out_n = int(ends[-1]) if len(ends) else 0
    if not out_n:
        return np.zeros(0, pool.dtype)
    ramp = np.arange(out_n) - np.repeat(ends - size, size)
    source = np.repeat(start, size) + ramp
    if common.all():
        return pool[source]
    from_own = np.repeat(~common, size)
    out = np.empty(out_n, pool.dtype)
    out[~from_own] = pool[source[~from_own]]
    out[from_own] = rest[source[from_own]]
    return out

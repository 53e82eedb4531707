"""Token ids in binary files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

A file holds documents in ascending id order:

    magic, version, lengths of all codes (zstd), blocks, document index (zstd), footer

A block has up to ``BLOCK_TOKENS`` ids of consecutive documents and starts at a byte; inside it the
bit offset of every ``CHECKPOINT``-th id is stored, so that decoding runs over all checkpoints at
once and any id is found by decoding at most ``CHECKPOINT`` ids.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.llm.arrowtext import slices, tidied
from civiltext.llm.files import Written, reading
from civiltext.llm.wordtable import ENCODE_ROWS, Looked, cut_for, flat_ids, hot_ids, hot_values, id_type_of, load_tokenizer, look_up, vocabulary_size
from civiltext.sources.storage import materialise, scratch_path

MAGIC = b"CTHF"
VERSION = 1
BLOCK_TOKENS = 1 << 16
CHECKPOINT = 128
#: The longest code; longer only where the number of different ids asks for it.
LONGEST = 18
#: Ids that a file and a range of documents aim at.
FILE_TOKENS = 32 << 20
RANGE_TOKENS = 8 << 20
#: Blocks that are decoded together.
TOGETHER = 16
#: Ids that are counted together.
COUNT_TOKENS = 1 << 20
#: Numbers that tell repeated rows apart in the order of documents.
TURNS = 1 << 30
U64 = np.uint64


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over ``longest``; 0 for ids that don't occur.

    Package-merge: coins of every level are paired and merged with the next level's. Since merging keeps
    the order of the counts, the leaves among the cheapest coins of a level are always its first ones.
    """
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    longest = max(longest, math.ceil(math.log2(n)))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, merged = [np.ones(n, bool)], leaves
    for _ in range(longest - 1):
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        merged = both[by]
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id), each one more than the one before, shifted where the length grows."""
    codes = np.zeros(len(lengths), U64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for n in np.unique(lengths[order]).tolist():
        code <<= n - last
        same = order[lengths[order] == n]
        codes[same] = np.arange(code, code + len(same), dtype=U64)
        code, last = code + len(same), n
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every bit string of the longest length: the id whose code it begins with, and that code's length."""
    width = int(lengths.max(initial=1))
    codes = canonical_codes(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, width - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << width, np.uint32), np.zeros(1 << width, np.uint8)
    ids[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    assert len(order) == 0 or int(codes[order[0]]) == 0
    return ids, sizes, width


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of a block and its checkpoints."""
    size = lengths[ids].astype(U64)
    ends = np.cumsum(size)
    starts = ends - size
    word, at = (starts >> U64(6)).astype(np.int64), starts & U64(63)
    over = at + size > U64(64)
    code = codes[ids]
    value = np.where(over, code >> np.where(over, at + size - U64(64), U64(0)), code << np.where(over, U64(0), U64(64) - at - size))
    out = np.zeros(int(word[-1]) + 2, U64)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[heads]] = np.bitwise_or.reduceat(value, heads)
    out[word[over] + 1] |= code[over] << (U64(128) - at[over] - size[over])
    total = int(ends[-1])
    return out.astype(">u8").tobytes()[: (total + 7) // 8], starts[::CHECKPOINT].astype("<u4")


def decode_blocks(bits: list[bytes], checkpoints: list[np.ndarray], sizes: list[int], table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of some blocks; all checkpoints of all blocks advance together."""
    ids, lengths, width = table
    raw = np.frombuffer(b"".join(bits) + b"\0" * 8, np.uint8).astype(np.uint32)
    windows = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bits])])[:-1] * 8
    at = np.concatenate([c.astype(np.int64) + b for c, b in zip(checkpoints, begin.tolist())])
    lanes = np.concatenate([np.minimum(CHECKPOINT, n - np.arange(0, n, CHECKPOINT)) for n in sizes])
    out = np.zeros((len(at), CHECKPOINT), np.uint32)
    mask, room = np.int64((1 << width) - 1), 32 - width
    limit = len(windows) * 8 - 8
    for step in range(CHECKPOINT):
        found = (windows[at >> 3].astype(np.int64) >> (room - (at & 7))) & mask
        out[:, step] = ids[found]
        at = np.minimum(at + lengths[found], limit)  # lanes that are at their end stay inside
    return out[np.arange(CHECKPOINT)[None, :] < lanes[:, None]]


class TokenFile:
    """Writes one file; memory is bounded by a block and the index of its documents."""

    def __init__(self, folder: str, name: str, lengths: np.ndarray, codes: np.ndarray):
        self.file, self.lengths, self.codes = Written(folder, name), lengths, codes
        packed = pa.compress(lengths.tobytes(), codec="zstd", asbytes=True)
        self.file.write(MAGIC + struct.pack("<HIII", VERSION, len(lengths), len(packed), CHECKPOINT) + packed)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.blocks = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held >= BLOCK_TOKENS:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        end = len(ids) if all_of_it else len(ids) // BLOCK_TOKENS * BLOCK_TOKENS
        for at in range(0, end, BLOCK_TOKENS):
            part = ids[at : min(end, at + BLOCK_TOKENS)]
            bits, marks = encode_block(part, self.lengths, self.codes)
            self.file.write(struct.pack("<III", len(part), len(bits), zlib.crc32(bits)) + marks.tobytes() + bits)
            self.blocks += 1
        self.waiting, self.held = [ids[end:]], len(ids) - end

    def close(self) -> tuple[str, int, int, int]:
        self._flush(True)
        has = np.array([i is not None for i in self.ids], bool)
        index = has.tobytes() + np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes()
        packed = pa.compress(index, codec="zstd", asbytes=True)
        self.file.write(packed + struct.pack("<QQQ", len(packed), len(self.ids), self.blocks) + MAGIC)
        self.file.close()
        return self.file.uri, len(self.ids), self.tokens, self.file.bytes


def read_file(stream, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of a file in its order, decoding a bounded number of blocks at a time."""
    stream.seek(0)
    if stream.read(4) != MAGIC:
        raise ValueError("not a token file")
    version, vocabulary, packed, step = struct.unpack("<HIII", stream.read(14))
    if version != VERSION or step != CHECKPOINT:
        raise ValueError(f"a token file of version {version} with checkpoints every {step} ids")
    lengths = np.frombuffer(pa.decompress(stream.read(packed), decompressed_size=vocabulary, codec="zstd", asbytes=True), np.uint8)
    first_block = stream.tell()
    stream.seek(size - 28)
    index_bytes, n, blocks = struct.unpack("<QQQ", stream.read(24))
    if stream.read(4) != MAGIC:
        raise ValueError("a token file that is cut off")
    stream.seek(size - 28 - index_bytes)
    index = pa.decompress(stream.read(index_bytes), decompressed_size=17 * n, codec="zstd", asbytes=True)
    has, names = np.frombuffer(index[:n], bool).tolist(), np.frombuffer(index[n : 9 * n], "<i8").tolist()
    sizes = np.frombuffer(index[9 * n :], "<u8").astype(np.int64)
    table = decoding_table(lengths)
    stream.seek(first_block)

    pool, doc = np.zeros(0, np.uint32), 0
    for at in range(0, blocks, TOGETHER):
        bits, marks, counts = [], [], []
        for _ in range(min(TOGETHER, blocks - at)):
            count, length, check = struct.unpack("<III", stream.read(12))
            marks.append(np.frombuffer(stream.read(4 * -(-count // CHECKPOINT)), "<u4"))
            bits.append(stream.read(length))
            counts.append(count)
            if zlib.crc32(bits[-1]) != check:
                raise ValueError("a block with a wrong checksum")
        pool = np.concatenate([pool, decode_blocks(bits, marks, counts, table)])
        ends = np.cumsum(sizes[doc:])
        whole = int(np.searchsorted(ends, len(pool), "right"))
        start = 0
        for i, end in zip(range(doc, doc + whole), ends[:whole].tolist()):
            yield (names[i] if has[i] else None), pool[start:end]
            start = end
        pool, doc = pool[start:], doc + whole
    if doc < n:
        raise ValueError("a token file with fewer ids than its index says")


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as compressed byte planes."""
    planes = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack_ids(packed: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(packed, decompressed_size=width * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(-1)


def slice_ids(seen: Looked, hot: np.ndarray, hot_at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of a slice of documents, each document's range in them); pieces outside the hot table are encoded here, each once."""
    tokenizer, kind, numbers = load_tokenizer(path), id_type_of(path), seen.numbers.copy()
    far = numbers < 0
    distinct, back = np.unique(seen.codes[far], return_inverse=True)
    numbers[far] = len(hot_at) - 1 + back
    rare, parts, sizes = seen.own.take(pa.array(distinct)), [hot], [np.diff(hot_at)]
    for at in range(0, len(rare), ENCODE_ROWS):
        coded = [c.ids for c in tokenizer.encode_batch_fast(rare.slice(at, ENCODE_ROWS).to_pylist(), add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
        parts.append(np.fromiter(chain.from_iterable(coded), kind, int(sizes[-1].sum())))
    pool, every = np.concatenate(parts), np.concatenate(sizes)
    size = every[numbers]
    ends = np.cumsum(size)
    # the place in the pool, less the place in the slice
    shift = (np.cumsum(every) - every)[numbers] - (ends - size)
    ids = pool[np.repeat(shift, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return ids, np.concatenate([[0], ends])[seen.rows]


def encoded_documents(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str) -> DataFrame:
    """(id, key, turn, n, data): every document of (id, text) as packed ids with the end id behind them.

    The frequent pieces of all texts are encoded once and given to every task; the others are encoded
    where they stand, once for a slice of documents, since most of them stand in one place only.
    """
    spark = docs.sparkSession
    cut = cut_for(tokenizer_path)
    common = hot_ids(docs, "text", tokenizer_path)
    shared = spark.sparkContext.broadcast((hot_values(common), *flat_ids(common, id_type_of(tokenizer_path))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ids_of, ids_at = shared.value
        turn = 0
        for part in slices(batches, "text"):
            seen = look_up(part, cut, values)
            ids, bounds = slice_ids(seen, ids_of, ids_at, tokenizer_path)
            ids = np.insert(ids.astype(kind), bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            yield pa.record_batch(
                {
                    "id": part.column("id"), "key": pa.array(seen.keys, pa.binary()),
                    "turn": pa.array(np.arange(turn, turn + len(spans)) % TURNS, pa.int32()),
                    "n": pa.array(np.diff(bounds), pa.int64()),
                    "data": pa.array([pack_ids(ids[a:b]) for a, b in spans], pa.binary()),
                }
            )
            turn += len(spans)

    return docs.mapInArrow(tidied(encode, load_tokenizer), "id long, key binary, turn int, n long, data binary")


def token_counts(coded: DataFrame, vocabulary: int, kind: str) -> np.ndarray:
    """Occurrences of every id in all encoded documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, parts, held = np.zeros(vocabulary, np.int64), [np.zeros(0, kind)], 0
        for batch in batches:
            for data, n in zip(batch.column("data").to_pylist(), batch.column("n").to_pylist()):
                parts.append(unpack_ids(data, n, kind))
                held += n
                if held >= COUNT_TOKENS:
                    total += np.bincount(np.concatenate(parts), minlength=vocabulary)
                    parts, held = [np.zeros(0, kind)], 0
        total += np.bincount(np.concatenate(parts), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.record_batch({"token": pa.array(seen, pa.int32()), "n": pa.array(total[seen])})

    rows = coded.select("data", "n").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    out = np.zeros(vocabulary, np.int64)
    out[rows.column("token").to_numpy()] = rows.column("n").to_numpy()
    return out


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encodes every whole text, ends each document with ``end_id`` and writes them in ascending id order.

    Returns the list of files (place, seq, uri, docs, tokens, bytes); in the order of (place, seq) they
    are the whole stream. Ids must be whole numbers; null ids come first, equal ids in the order of
    their texts' hashes. Texts are cut twice: to count their pieces and to encode them. Code lengths come
    from the counts of all ids in the written table of encoded documents, which then move once, to
    their range of ids; repeated rows may fill several ranges.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    vocabulary = max(vocabulary_size(tokenizer_path), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    coded = materialise(encoded_documents(plain, tokenizer_path, end_id, kind), "encoded-documents")
    counts = token_counts(coded, vocabulary, kind)
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    ranges = max(2 * spark.sparkContext.defaultParallelism, int(counts.sum()) // RANGE_TOKENS)
    order = ("id", "key", "turn")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, words = shared.value
        place, attempt = TaskContext.get().partitionId(), TaskContext.get().attemptNumber()
        out, seq, done = None, 0, []
        for batch in batches:
            for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "data"))):
                if out is None:
                    out = TokenFile(folder, f"tokens-{place:06d}-{seq:04d}-{attempt}.hft", sizes, words)
                out.add(doc, unpack_ids(data, n, kind))
                if out.tokens >= FILE_TOKENS:
                    done.append((place, seq, *out.close()))
                    out, seq = None, seq + 1
        if out is not None:
            done.append((place, seq, *out.close()))
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names=["place", "seq", "uri", "docs", "tokens", "bytes"])

    placed = coded.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "n", "data")
    listed = placed.mapInArrow(tidied(write), "place long, seq long, uri string, docs long, tokens long, bytes long")
    return materialise(listed, "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids): every document of the listed files with the number of ids before it."""
    spark = files.sparkSession
    total, rows = 0, []
    for r in files.orderBy("place", "seq").collect():  # one row for each file
        rows.append((r["uri"], r["bytes"], total))
        total += r["tokens"]
    listed = spark.createDataFrame(rows, "uri string, bytes long, base long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                at, out, held = f["base"], [], 0
                with reading(f["uri"]) as stream:
                    for doc, ids in read_file(stream, f["bytes"]):
                        out.append((doc, at, len(ids), ids.astype("<u4").tobytes()))
                        at, held = at + len(ids), held + len(ids)
                        if held >= 1 << 20:
                            yield _rows(out)
                            out, held = [], 0
                if out:
                    yield _rows(out)

    return listed.mapInArrow(tidied(read), "id long, start long, n_tokens long, ids binary")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*out)
    return pa.record_batch({"id": pa.array(a, pa.int64()), "start": pa.array(b, pa.int64()), "n_tokens": pa.array(c, pa.int64()), "ids": pa.array(d, pa.binary())})


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the documents' ids to the shared folder and reads them back.

    A null text is empty and gives the end id alone; an empty table gives no files and no rows.
    """
    files = write_token_files(docs, tokenizer_path, scratch_path(docs.sparkSession, "tokens"), id_col, text)
    return read_token_files(files).withColumnRenamed("id", id_col)

"""Terms contained in texts, for term tables of any size: windows of the text by rolling hash, joined on the term.

A text has one array of prefix sums of byte times power, from which the hash of any window is one
subtraction and one product. Windows are made for the lengths that the terms have; a bitmap of the
terms' hashes lets through those that may be terms, and these, as short strings, are joined with the
table. The bitmap has a fixed size, so a larger table only lets more windows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.operators.joins import lookup_join

#: Bits of the filter, as a power of two: 4 MB.
FILTER_BITS = 25
#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Windows:
    """Hashes of all windows of some bytes."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.back = _powers(INVERSE, self.n + 1)
        self.sums = np.concatenate([[U64(0)], np.cumsum((data.astype(U64) + U64(1)) * _powers(BASE, self.n + 1)[: self.n], dtype=U64)])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[starts + length] - self.sums[starts]) * self.back[starts] + U64(length)
        h ^= h >> U64(29)
        return (h * U64(0xBF58476D1CE4E5B9)) >> U64(64 - FILTER_BITS)


def term_filter(terms: DataFrame) -> tuple[list[int], np.ndarray]:
    """(byte lengths, bitmap of the hashes) of a table's terms; the bitmap's words are put together in Spark."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes_of(batch.column("term"))
            size, windows, bit = np.diff(at), Windows(data), np.zeros(batch.num_rows, np.int64)
            for length in np.unique(size).tolist():
                here = size == length
                bit[here] = windows.of(at[:-1][here], length).astype(np.int64)
            yield pa.record_batch({"length": pa.array(size), "word": pa.array(bit >> 6), "bit": pa.array(bit & 63)})

    found = terms.select("term").mapInArrow(bits, "length long, word long, bit long")
    lengths = [r["length"] for r in found.select("length").distinct().collect()]  # at most the longest term
    words = found.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits")).toArrow()  # at most the filter
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return sorted(lengths), bitmap.view(U64)


def contained_terms(texts: DataFrame, table: DataFrame, key: str, text: str) -> DataFrame:
    """Every (row of ``texts``, row of ``table``) whose ``term`` is a part of the text, once: ``key`` and the table's columns.

    An empty term and a null are part of nothing. Rows with equal keys are found each for itself, so
    a key may come back several times. Nothing but keys and windows that may be terms is shuffled.
    """
    table = table.filter("term <> ''")
    context = texts.sparkSession.sparkContext
    lengths, bitmap = term_filter(table.select("term").distinct())
    shared = context.broadcast(bitmap)
    kind = texts.schema[key].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = 0
            _, offsets = _bytes_of(batch.column("t"))
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
                part = batch.slice(at, end - at)
                at = end
                data, bounds = _bytes_of(part.column("t"))
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                room = bounds[1:][row] - np.arange(len(data))
                first = (data & 0xC0) != 0x80  # a character begins here
                hashes, raw = Windows(data), data.tobytes()
                seen: set[tuple[int, bytes]] = set()
                for length in lengths:
                    starts = np.flatnonzero(first & (room >= length))
                    h = hashes.of(starts, length)
                    likely = starts[(bits[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 1]
                    seen.update(zip(row[likely].tolist(), (raw[i : i + length] for i in likely.tolist())))
                # a window may end inside a character; then it is no term
                good = [(r, t) for r, w in seen if (t := w.decode("utf-8", "ignore")).encode() == w]
                if good:
                    rows, strings = zip(*good)
                    yield pa.record_batch({"k": part.column("k").take(pa.array(rows, pa.int64())), "term": pa.array(strings, pa.string())})

    slim = texts.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter("t is not null")
    found = slim.mapInArrow(windows, f"k {kind}, term string")
    return lookup_join(found, table, ["term"]).select(F.col("k").alias(key), *table.columns)

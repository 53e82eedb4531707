"""Whole Arrow columns of text as bytes and offsets: the vectorised base of the text operators.

Everything works on slices of a bounded number of bytes, so that a task's memory
does not grow with its partition. A null text is an empty one.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken at once; one longer document is a slice of its own.
SLICE_BYTES = 4 << 20

#: ASCII white space: the space and 0x09 to 0x0D.
SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def as_string(column: pa.Array) -> pa.Array:
    """A null-free string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or large binary column, offsets from 0."""
    if not pa.types.is_large_binary(column.type):
        column = as_string(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most ``most`` bytes of text, one row at least."""
    for batch in batches:
        _, off = buffers(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and each row's range in them."""
    solid = ~IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        first[heads], last[tails] = solid[heads], solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words as one string array, and each row's range in it."""
    starts, ends, rows = word_bounds(data, offsets)
    return joined(data[~IS_SPACE[data]], np.concatenate([[0], np.cumsum(ends - starts)])), rows


def joined(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *caches) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of a task that gives its memory back at the end: worker processes stay for later tasks, and
    what their allocators and the given caches keep would count against the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            for cache in caches:
                cache.cache_clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # a C library without it
                pass

    return run

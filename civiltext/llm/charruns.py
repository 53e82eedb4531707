"""Runs of given bytes in whole Arrow columns of text, as one array of words with each row's range in it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from civiltext.llm.arrowtext import LOWER, buffers, joined

#: ASCII letters and every byte of a character outside ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: The same and the digits 0 to 9.
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True


@dataclass
class Runs:
    """The runs of a slice: ``data`` holds their bytes behind one another (A-Z lower-cased), ``at`` their bounds in it."""

    data: np.ndarray
    at: np.ndarray
    rows: np.ndarray  # each row's range in the runs

    @property
    def strings(self) -> pa.Array:
        return joined(self.data, self.at)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def lower_runs(texts: pa.Array, member: np.ndarray) -> Runs:
    """The longest runs of ``member`` bytes in every text, lower-cased; a null text has none."""
    data, offsets = buffers(texts)
    solid = member[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        first[heads], last[tails] = solid[heads], solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Runs(LOWER[data[solid]], np.concatenate([[0], np.cumsum(ends - starts)]), np.searchsorted(starts, offsets))

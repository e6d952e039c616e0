"""Word hashes of whole Arrow text columns, a few vector operations per byte.

A word is a maximal run of characters other than space and U+0009..U+000D. Texts are hashed in slices of whole documents of about
``SLICE`` bytes, so memory is bounded by the slice or by the longest single text. Hashes have 64 bits and depend on the text alone,
so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
ODD = 0x9E3779B97F4A7C15
BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes the words of text columns; holds the tables of powers that slices share."""

    def __init__(self, lower: bool = False):
        codes = np.arange(256, dtype=np.uint64)
        if lower:
            codes[65:91] = codes[97:123]
        self.values = mix((codes + np.uint64(1)) * np.uint64(ODD))
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def slices(self, column: pa.Array) -> Iterator[tuple]:
        """Yields (first row, row limits in words, word hashes, first byte of each word, byte after each word, bytes, byte limits)."""
        column = column.cast(pa.large_string())
        if not len(column):
            return
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE, side="right")) - 1)
            yield (row, *self._hash(data[ends[row]:ends[stop]], ends[row:stop + 1] - ends[row]))
            row = stop

    def _hash(self, text: np.ndarray, limits: np.ndarray) -> tuple:
        n = len(text)
        if n > len(self.up):
            size = max(n, SLICE + 1)
            self.up, self.down = powers(size, BASE), powers(size, pow(BASE, -1, 1 << 64))
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~self.space[text]
        cut = np.zeros(n + 1, dtype=bool)
        cut[limits] = True
        begin = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.values[text] * self.up[:n], out=sums[1:])
            hashes = mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * np.uint64(ODD))
        return np.searchsorted(begin, limits), hashes, begin, end, text, limits


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` hashes, also of runs that cross a document limit."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(BASE) + hashes[j:j + n]
        return mix(out + np.uint64(size))


def rows_of(limits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``size`` words: the index of every run inside one row, and that row's number."""
    counts = np.maximum(np.diff(limits) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(limits[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(counts) else counts
    return first + np.arange(len(row)), row

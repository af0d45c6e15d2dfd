"""Word and shingle hashes of many texts at once, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
FOLD = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows with about ``most`` bytes; nulls count as empty."""
    column = pa.array(column.fill_null(b""), pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, data[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


class Words:
    """Hashes of words (runs of anything but ASCII white space, A-Z as a-z); made once per task."""

    def __init__(self, lower: bool = True) -> None:
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        if lower:
            table[65:91] = table[97:123]
        self.table = table
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, position of each text's first word, with the total at the end)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
        self._powers(n)
        inside = ~self.space[data]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        first, last = offs[:-1][offs[:-1] < n], offs[1:][offs[1:] > 0] - 1
        start[first], end[last] = inside[first], inside[last]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=total[1:])
        h = (total[e] - total[s]) * self.down[s]
        return mix(h ^ ((e - s).astype(np.uint64) * np.uint64(FOLD))), np.searchsorted(s, offs)

    def shingles(self, data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k``-word shingles in order, not distinct, and each text's first position. A text of fewer
        words is one shingle; a text without words has none."""
        h, first = self.words(data, offs)
        counts = np.diff(first)
        number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        out = np.empty(int(number.sum()), np.uint64)
        many = np.repeat(counts >= k, number)
        if many.any():
            g = h[:len(h) - k + 1].copy()
            for j in range(1, k):
                g = g * np.uint64(FOLD) + h[j:len(h) - k + 1 + j]
            end = np.repeat(first[1:], counts)[:len(g)]
            out[many] = mix(g)[np.arange(len(g)) + k <= end]
        if not many.all():
            few = (counts > 0) & (counts < k)
            g, left = np.full(int(few.sum()), FOLD, np.uint64), counts[few]
            for j in range(k - 1):
                on = left > j
                g[on] = (g[on] + np.uint64(1)) * np.uint64(BASE) + h[first[:-1][few][on] + j]
            out[~many] = mix(g ^ left.astype(np.uint64))
        return out, np.concatenate([[0], np.cumsum(number)])


def text_shingles(words: Words, text: bytes, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    data = np.frombuffer(text, np.uint8)
    return np.unique(words.shingles(data, np.array([0, len(data)], np.int64), k)[0])

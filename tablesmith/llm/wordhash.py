"""64-bit hashes of the words and word shingles of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a 64-bit finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    """Hashes words ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z.

    A word's hash is the polynomial of its bytes, read off one running sum over the whole buffer and shifted
    back to the word's start; a finaliser follows.
    """

    def __init__(self) -> None:
        bytes_ = np.arange(256, dtype=np.uint64)
        self.values = mix(bytes_ + np.uint64(1))
        self.values[65:91] = self.values[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _reach(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE, np.uint64)])

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts, and for each text the range of its words."""
        column = column.fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        if data is None or offsets[-1] == offsets[0]:
            return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self._reach(len(data) + 1)
        inside = ~self.space[data]
        breaks = offsets[:-1][offsets[:-1] < len(data)]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[breaks] = inside[breaks]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = inside[ends]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last)
        terms = self.values[data] * self.powers[: len(data)]
        sums = np.cumsum(terms)
        hashes = (sums[stops] - sums[starts] + terms[starts]) * self.inverses[starts]
        return mix(hashes), np.searchsorted(starts, offsets)

    def shingles(self, column: pa.Array, k: int) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its ``k``-word shingles; a shorter text is one shingle."""
        words, bounds = self.words(column)
        count = max(0, len(words) - k + 1)
        rolled = np.zeros(count, np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(_BASE) + words[j : j + count]
        rolled = mix(rolled)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                sets.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for j in range(a, b):
                    short = short * np.uint64(_BASE) + words[j : j + 1]
                sets.append(mix(short))
            else:
                sets.append(np.empty(0, np.uint64))
        return sets

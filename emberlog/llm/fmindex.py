"""A compressed full-text index over word numbers: Burrows-Wheeler transform, wavelet matrix, backward search.

Suffixes are sorted by their first ``DEPTH`` symbols only, which is enough for
the intervals of patterns up to that length. The suffix array is only built on the way: what
stays is the transform in a wavelet matrix, one and a half bits for each bit of a symbol, and for
each place of it the value (here: the document) that an interval's least is asked of.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


#: The bits below each place of a 64-bit word.
_BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each, in half a word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        room = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        room[: len(packed)] = packed
        self.words = room.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BELOW[at & 63])


class Wavelet:
    """A wavelet matrix: a bit vector for each bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.depth = max(1, int(count - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            bits = Bits(bit)
            self.levels.append((bits, len(symbols) - bits.ones))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.start = self.descend(np.arange(count, dtype=np.int32), np.zeros(count, np.int32))

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where(symbols >> (self.depth - 1 - k) & 1, np.int32(zeros) + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.descend(symbols, at) - self.start[symbols]


class Index:
    """An index of a text of symbols 0 to count-1, of fewer than 2**31, with a value of each of its places."""

    def __init__(self, text: np.ndarray, count: int, values: np.ndarray):
        n = len(text)
        if n >= 1 << 31:
            raise ValueError("a text too long for one index")
        rank, step = text.astype(np.int64), 1
        while step < DEPTH:
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            _, rank = np.unique(rank * (n + count + 2) + after, return_inverse=True)
            step *= 2
        suffixes = np.argsort(rank, kind="stable")
        self.size, self.values = n, values[suffixes]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=count))]).astype(np.int32)
        self.wavelet = Wavelet(text[suffixes - 1].astype(np.int32), count)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the patterns with a symbol put before each."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.before[symbols] + both[: len(low)], self.before[symbols] + both[len(low) :]

    def matching(self, text: np.ndarray, ends: np.ndarray, length: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of positions in a text, up to a threshold.

        For the runs of ``length`` symbols that end at ``ends``: which of them
        occur at least ``least`` times in the index, and the intervals of these.
        A run is given up as soon as its last symbols occur less often, or if any of its symbols does.
        """
        often = np.diff(self.before)[text] >= least
        upto = np.concatenate([[0], np.cumsum(often)])
        alive = np.flatnonzero(upto[ends + 1] - upto[ends + 1 - length] == length)
        last = text[ends[alive]]
        low, high = self.before[last], self.before[last + 1]
        for step in range(1, length):
            low, high = self.extend(text[ends[alive] - step], low, high)
            go = high - low >= least
            alive, low, high = alive[go], low[go], high[go]
        return alive, low, high

    def least_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value in each interval; intervals are equal or disjoint."""
        if not len(low):
            return self.values[:0]
        starts, first, back = np.unique(low, return_index=True, return_inverse=True)
        cuts = np.stack([starts, high[first]], 1).ravel()
        padded = np.append(self.values, self.values[-1:])
        return np.minimum.reduceat(padded, cuts)[::2][back]

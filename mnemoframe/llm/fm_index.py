"""A compressed full-text index over sequences of symbols: suffix order, wavelet tree, backward search."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence, level by level of their bits, in packed bit vectors.

    Symbols are 0 to ``2**levels - 1``.  At each level the sequence is split stably by a
    bit, highest first; a rank follows its symbol's bits down the levels.
    """

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels, self.words, self.before, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bits = (sequence >> level & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bits, (0, 64 + -len(bits) % 64)), bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int32)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(ones[:-1], dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(bits) - int(bits.sum()))
            sequence = np.concatenate((sequence[bits == 0], sequence[bits == 1]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def ranks(self, symbols: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
        """For each end: how often each symbol stands before that place of the sequence."""
        start = np.zeros(len(symbols), dtype=np.int64)
        for level in range(self.levels):
            one = (symbols >> (self.levels - 1 - level) & 1).astype(bool)
            moved = []
            for at in (start, *ends):
                ones = self._ones(level, at)
                moved.append(np.where(one, self.zeros[level] + ones, at - ones))
            start, *ends = moved
        return [end - start for end in ends]


class FmIndex:
    """Index of a sequence of positive symbols, 0 as separator, for patterns of up to ``depth`` symbols.

    Suffixes are ordered by their first ``depth`` symbols at least, which is all that the
    intervals of such patterns depend on.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        self.size = len(symbols)
        rank, step = symbols.astype(np.int64), 1
        while step <= depth:
            following = np.concatenate((rank[step:] + 1, np.zeros(min(step, self.size), dtype=np.int64)))
            rank = np.unique(rank * (int(following.max()) + 1) + following, return_inverse=True)[1]
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.levels = max(1, int(symbols.max()).bit_length())
        self.tree = WaveletTree(symbols[order - 1].astype(np.int64), self.levels)
        # places of the suffixes that begin with each symbol
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max()) + 2))))

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the intervals of the patterns with a symbol put before each."""
        low, high = self.tree.ranks(symbols, [low, high])
        return self.first[symbols] + low, self.first[symbols] + high

    def repeated(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the patterns ``symbols[s:s + length]`` occur more than once, and where their
        intervals begin; equal patterns have equal intervals.

        The search for a pattern ends as soon as its matching statistic shows that only one
        occurrence of what was read is left.
        """
        alive = np.arange(len(starts))
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.size, dtype=np.int64)
        for back in range(length - 1, -1, -1):
            low, high = self.extend(low, high, symbols[starts[alive] + back])
            more = high - low > 1
            alive, low, high = alive[more], low[more], high[more]
        return alive, low

"""An FM-index over a text of small integers, in numpy; symbol 0 breaks the text and is never searched for."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order. text ends with a break; breaks are smaller than all symbols, and each differs from the others."""
    n = len(text)
    breaks = text == 0
    n_breaks = int(breaks.sum())
    first = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + n_breaks)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks of the sorted suffixes at the places `at`; returns the places whose suffixes are still tied."""
        new = np.r_[True, key[1:] != key[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[order[at]] = at[start]
        tied = ~new | np.r_[~new[1:], False]
        return at[tied]

    tied = regroup(np.arange(n), first[order])
    reach = 1
    while len(tied):
        suffixes = order[tied]
        key = rank[suffixes] * n + rank[suffixes + reach]
        sort = np.argsort(key, kind="stable")
        order[tied] = suffixes[sort]
        tied = regroup(tied, key[sort])
        reach *= 2
    return order


class WaveletTree:
    """Ranks in a sequence: one bit row for each bit of a symbol, each row ordered by the bits before it."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.shifts = range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        here = sequence
        starts = np.zeros(n_symbols, np.int64)
        symbols = np.arange(n_symbols)
        for shift in self.shifts:
            bit = (here >> shift & 1).astype(bool)
            self.ones.append(np.r_[np.int32(0), np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(len(here) - int(self.ones[-1][-1]))
            here = np.concatenate([here[~bit], here[bit]])
            starts = self._down(len(self.ones) - 1, symbols >> shift & 1, starts)
        self.starts = starts

    def _down(self, level: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = self.ones[level][at]
        return np.where(bit, self.zeros[level] + ones, at - ones)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        for level, shift in enumerate(self.shifts):
            at = self._down(level, symbols >> shift & 1, at)
        return at - self.starts[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int, step: int = 8):
        order = suffix_order(text)
        self.last = text[order - 1]
        self.tree = WaveletTree(self.last, n_symbols)
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        # positions are kept for every step-th suffix and for those that follow a break, so no walk crosses one
        self.sampled = (order % step == 0) | (self.last == 0)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [lo, hi) of each row of `patterns` (all of one length), by backward search."""
        c = patterns[:, -1]
        lo, hi = self.below[c], self.below[c + 1]
        live = np.flatnonzero(lo < hi)
        for j in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[live, j]
            lo[live] = self.below[c] + self.tree.rank(c, lo[live])
            hi[live] = self.below[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix, by walking back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            c = self.last[at[open_]]
            at[open_] = self.below[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return self.samples[self.sample_at[at]] + steps

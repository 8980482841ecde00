"""An FM-index over runs of word ids, small enough for one task: wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix positions in order. Every 0 is a separator and counts as a symbol of its own, so no comparison crosses it;
    the number of doubling rounds follows the longest repeated run."""
    n = len(seq)
    gaps = seq == 0
    n_gaps = int(gaps.sum())
    rank = seq.astype(np.int64) + n_gaps
    rank[gaps] = np.arange(n_gaps)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        if step < n:
            after[: n - step] = rank[step:]
        key = rank * np.int64(n + n_gaps + int(seq.max(initial=0)) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2


class FMIndex:
    """Index of a sequence of ids 1..``symbols`` in which 0 separates the runs; the first and last symbol must be 0."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8) -> None:
        order = suffix_order(seq)
        before = np.where(order > 0, order - 1, len(seq) - 1)
        bwt = seq[before].astype(np.int64)
        self.below = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=symbols + 1), out=self.below[1:])
        # Wavelet matrix: one level per bit, highest first; `ones` holds the ranks of set bits.
        self.bits = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for bit in range(self.bits - 1, -1, -1):
            b = (level >> bit) & 1
            ones = np.zeros(len(b) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(b) - int(ones[-1]))
            level = np.concatenate([level[b == 0], level[b == 1]])
        every = np.arange(symbols + 1)
        self.first = self._down(every, np.zeros(symbols + 1, np.int64))
        # A run's first position is always sampled, so walking back never crosses a separator.
        kept = (order % sample == 0) | (bwt == 0)
        self.kept = kept
        self.kept_rank = np.cumsum(kept) - 1
        self.samples = order[kept]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            found = ones[at]
            at = np.where(bit == 1, zeros + found, at - found)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position of the transform."""
        return self._down(symbol, at) - self.first[symbol]

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """Symbols at positions of the transform."""
        out = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, padded on the right) at once: first and past row of each, equal if absent."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n:
            return lo, hi
        last = phrases[np.arange(n), lengths - 1]
        lo[:], hi[:] = self.below[last], self.below[last + 1]
        for step in range(1, int(lengths.max())):
            on = np.flatnonzero((lengths > step) & (hi > lo))
            if not len(on):
                break
            c = phrases[on, lengths[on] - 1 - step]
            lo[on] = self.below[c] + self.rank(c, lo[on])
            hi[on] = self.below[c] + self.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to the next sampled one and add the steps."""
        out = np.zeros(len(rows), np.int64)
        on, at, steps = np.arange(len(rows)), rows, 0
        while len(on):
            done = self.kept[at]
            out[on[done]] = self.samples[self.kept_rank[at[done]]] + steps
            on, at = on[~done], at[~done]
            if len(on):
                c = self.symbol(at)
                at = self.below[c] + self.rank(c, at)
            steps += 1
        return out

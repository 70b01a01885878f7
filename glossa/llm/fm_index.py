"""An FM-index over a sequence of small integers: suffix order, wavelet-matrix ranks, sampled positions.

Symbol 0 separates texts: it is never searched for, and no match crosses it.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; each separator counts as a symbol of its own, ordered by position.

    Prefix doubling: several symbols are packed into the first key, later rounds sort only what is still tied.
    The sequence must end with a separator.
    """
    n = len(symbols)
    stop = symbols == 0
    z = int(stop.sum())
    first = np.where(stop, np.cumsum(stop) - 1, symbols.astype(np.int64) + z)
    bits = max(1, int(first.max()).bit_length())
    h = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for i in range(h):
        key <<= bits
        key[: max(0, n - i)] |= first[i:]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = np.diff(key[order]) != 0
    start = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    rank[order] = start[np.cumsum(new) - 1]
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots):
        tied = order[slots]
        key = rank[tied] << 32 | rank[np.minimum(tied + h, n)]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[slots] = tied = tied[by]
        new = np.ones(len(slots), bool)
        new[1:] = np.diff(key) != 0
        rank[tied] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = 32):
        n = self.n = len(symbols)
        order = suffix_order(symbols)
        last = symbols[order - 1]  # the symbol before each suffix
        top = int(symbols.max()) if n else 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])  # rows of smaller symbols
        kept = (order % sample == 0) | (last == 0)  # a walk back ends at a sample or at the start of a text
        self.kept = kept
        self.kept_before = np.cumsum(kept, dtype=np.int32)
        self.positions = order[kept]
        # wavelet matrix of `last`: by level, ones before each place, and the number of zeros
        self.levels = max(1, top.bit_length())
        self.ones, self.zeros = [], []
        seq = last
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.node = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))
        self.top = top

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            o = ones[i]
            i = np.where(c >> level & 1, zeros + o, i - o)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before place i of the last column."""
        return self._down(c, i) - self.node[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of a matrix at once: (pattern, first row, end row) of those that occur."""
        live = np.flatnonzero((patterns <= self.top).all(1)) if len(patterns) else np.zeros(0, np.int64)
        if not len(live) or not self.n:
            return live[:0], live[:0], live[:0]
        c = patterns[live, -1]
        lo, hi = self.first[c], self.first[c + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            on = lo < hi
            live, lo, hi = live[on], lo[on], hi[on]
            c = patterns[live, j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
        on = lo < hi
        return live[on], lo[on], hi[on]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their rows: walk back to a sampled one and count the steps."""
        out = np.zeros(len(rows), np.int64)
        at, todo, steps = rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            done = self.kept[at]
            out[todo[done]] = self.positions[self.kept_before[at[done]] - 1] + steps
            at, todo = at[~done], todo[~done]
            c, i = np.zeros(len(at), np.int64), at
            for ones, zeros in zip(self.ones, self.zeros, strict=True):
                o = ones[i]
                bit = ones[i + 1] - o
                c = c << 1 | bit
                i = np.where(bit, zeros + o, i - o)
            at = self.first[c] + i - self.node[c]
            steps += 1
        return out

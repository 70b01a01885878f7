"""Maximal repeats from an enhanced suffix array: the tree of common-prefix intervals, scanned with a stack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from glossa.llm.fm_index import suffix_order


class RollingHash:
    """64-bit hashes of any substring from sums over a prefix; bytes stand for random numbers."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(1, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = 1 << len(data).bit_length()
            powers = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))])
            self.up, self.down = powers(self.base), powers(self.inverse)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[begin]) * self.down[begin]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class EnhancedSuffixArray:
    """Suffixes of several texts in order, with common-prefix lengths that stop at the end of a text."""

    def __init__(self, texts: list[bytes], min_len: int, hasher: RollingHash):
        lens = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lens + 1) - 1  # the separators
        self.begins = self.ends - lens
        data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        symbols = data.astype(np.int32) + 1
        symbols[self.ends] = 0
        self.order = suffix_order(symbols)[len(texts) :]  # without the separators
        self.left = symbols[self.order - 1]
        self.left[self.order == 0] = 0
        rest = np.repeat(self.ends, lens + 1)[self.order] - self.order
        sums = hasher.sums(data)
        a, b = self.order[:-1], self.order[1:]
        room = np.minimum(rest[:-1], rest[1:])
        self.lcp = np.zeros(len(self.order) + 1, np.int64)  # lcp[i] is of rows i-1 and i; exact from min_len on
        near = np.flatnonzero(room >= min_len)
        near = near[hasher.of(sums, a[near], a[near] + min_len) == hasher.of(sums, b[near], b[near] + min_len)]
        lo, hi = np.full(len(near), min_len), room[near]
        while len(near) and (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = hasher.of(sums, a[near], a[near] + mid) == hasher.of(sums, b[near], b[near] + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        self.lcp[near + 1] = lo
        self.min_len = min_len

    def groups(self) -> Iterator[tuple[int, int, int]]:
        """(length, first row, end row) of every maximal repeat: an interval of the tree whose suffixes are not all
        preceded by the same byte. Runs without such diversity lie inside longer repeats and are not scanned."""
        deep = self.lcp >= self.min_len
        first = np.flatnonzero(deep & ~np.append(False, deep[:-1])) - 1
        end = np.flatnonzero(deep & ~np.append(deep[1:], False)) + 1
        for a, b in zip(first.tolist(), end.tolist(), strict=True):
            left = self.left[a:b]
            if left[0] and (left == left[0]).all():
                continue
            lcp, chars = self.lcp[a:b].tolist(), left.tolist()
            # an open interval: its length, first row, and the one byte before all its suffixes so far (-1: several)
            stack: list[list[int]] = []
            for i in range(1, b - a + 1):
                new = lcp[i] if i < b - a else 0
                start, char = i - 1, chars[i - 1] or -1
                while stack and stack[-1][0] > new:
                    length, start, c = stack.pop()
                    char = c if c == char else -1
                    if char < 0:
                        yield length, a + start, a + i
                if stack and stack[-1][0] == new:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == char else -1
                elif new:
                    stack.append([new, start, char])

    def where(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, offset) of suffixes by row."""
        at = self.order[rows]
        text = np.searchsorted(self.ends, at)
        return text, at - self.begins[text]

    def covered(self) -> list[list[tuple[int, int]]]:
        """For each text the spans that maximal repeats of min_len or more cover, merged."""
        reach = np.zeros(len(self.order), np.int64)
        for length, a, b in self.groups():
            np.maximum(reach[a:b], length, out=reach[a:b])
        rows = np.flatnonzero(reach)
        text, offset = self.where(rows)
        out: list[list[tuple[int, int]]] = [[] for _ in self.ends]
        for k in np.lexsort((offset, text)).tolist():
            spans, begin, end = out[text[k]], int(offset[k]), int(offset[k] + reach[rows[k]])
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((begin, end))
        return out


def repeat_groups(texts: list[bytes], min_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Every maximal repeat of min_len bytes or more with all its occurrences (text, offset)."""
    if not any(texts):
        return []
    esa = EnhancedSuffixArray(texts, min_len, RollingHash())
    return [(n, sorted(zip(*(x.tolist() for x in esa.where(np.arange(a, b))), strict=True))) for n, a, b in esa.groups()]

"""Subword pieces: merges of the most frequent neighbours, learned over distinct words, and texts cut into them.

Learning merge by merge would scan the words thousands of times. A merge changes only the counts of pairs beside it,
and a pair that a merge makes is never more frequent than the pair of the same boundary was before. So a round takes
the most frequent pairs (heavy ones, all above a count c), keeps of each word the stretches in which every boundary is
heavy, and adds equal stretches up. That little is enough to replay merges exactly, with counts kept as they change,
for as long as the best pair stays above what a boundary that was not kept could add. The words are scanned twice a
round, and a few dozen rounds give thousands of merges. In tasks symbols are numbers, and a batch's words one array.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from glossa.functions import text
from glossa.operators import tfidf as T

#: Pieces of a trained set, and the share of all characters that may take part in merges; 4 numbers are special ones.
VOCABULARY, COVERAGE, SPECIAL = 8000, 0.9995, 4
#: A word begins with this mark, as the blank before it.
MARK = "▁"
#: Heavy pairs and stretches of a round, at most: this much comes to the driver, whatever the size of the corpus.
HEAVY, STRETCHES = 4096, 200_000
#: Heavy pairs of the first round over more words than that: letters as such are in most words, and cut them little.
START = 64

Pair = tuple[str, str]


#: Partial sums that a task holds before it sends them on.
HELD = 1 << 18
#: What str.split takes for white space beyond what Unicode does.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _split(t: str) -> list[str]:
    return [w for w in _WHITE.split(t) if w] if _SEPARATORS.search(t) else t.split()


def marked_words(df: DataFrame, by: list[str], text_col: str) -> DataFrame:
    """(by, word, n): words between white space, with the mark in front. A null text has none."""
    kinds = [df.schema[c] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        schema = None

        def sums() -> pa.RecordBatch:
            keys = [k for k, c in counts.items() for _ in range(len(c))]
            columns = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(len(by))]
            words = pa.array([w for c in counts.values() for w in c], pa.string())
            return pa.RecordBatch.from_arrays([*columns, words, pa.array([n for c in counts.values() for n in c.values()], pa.int64())], [*by, "word", "n"])

        for b in batches:
            schema = b.schema
            for *key, t in zip(*(c.to_pylist() for c in b.columns[:-1]), b.column(len(by)), strict=True):
                if t.is_valid:
                    counts[tuple(key)].update(_split(t.as_py()))
                    if len(counts) > 1000 or len(counts[tuple(key)]) > HELD:
                        yield sums()
                        counts.clear()
        if counts:
            yield sums()

    made = [types.StructField("word", types.StringType()), types.StructField("n", types.LongType())]
    some = df.select(*by, text_col).mapInArrow(run, types.StructType(kinds + made))
    return some.groupBy(*by, "word").agg(F.sum("n").alias("n")).withColumn("word", F.concat(F.lit(MARK), "word"))


def _totals(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(key) else n


def _summed(df: DataFrame, keys_of) -> DataFrame:
    """(key, n): sums over numbers that keys_of gives of each batch, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            key, n = keys_of(b)
            held, counts = _totals(np.concatenate([held, key]), np.concatenate([counts, n]))
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["key", "n"])
                held, counts = held[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["key", "n"])

    return df.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins and the last ends."""
    some = words.to_pylist()
    return text.points_of("".join(some)), np.cumsum([0, *map(len, some)])


def covered_characters(words: DataFrame, coverage: float) -> list[str]:
    """The most frequent characters that together make up the share, smallest first among equals."""

    def keys_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        points, at = _points(b.column(0))
        return points.astype(np.int64), np.repeat(b.column(1).to_numpy(), np.diff(at))

    chars = _summed(words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL"), keys_of)
    rows = sorted(((r["n"], chr(r["key"])) for r in chars.collect()), key=lambda r: (-r[0], r[1]))  # as many as a script has
    total, so_far, out = sum(n for n, _ in rows), 0, []
    for n, c in rows:
        if so_far >= coverage * total:
            break
        so_far += n
        out.append(c)
    return out


def merged(symbols: list[str], a: str, b: str) -> list[str]:
    """Every a before b made one symbol, from the left."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


#: Numbers of symbols: a character's is its code point, longer ones follow.
LONGER = 0x110000


class Symbols:
    """Numbers of the symbols of more than one character that merges have made."""

    def __init__(self, merges: list[Pair] = ()):
        self.names: list[str] = []
        self.numbers: dict[str, int] = {}
        self.add(merges)

    def add(self, merges: list[Pair]) -> None:
        for a, b in merges:
            if a + b not in self.numbers:
                self.numbers[a + b] = LONGER + len(self.names)
                self.names.append(a + b)

    def number(self, symbol: str) -> int:
        return ord(symbol) if len(symbol) == 1 else self.numbers[symbol]

    def name(self, number: int) -> str:
        return chr(number) if number < LONGER else self.names[number - LONGER]

    def code(self, pair: Pair) -> int:
        return self.number(pair[0]) << 32 | self.number(pair[1])

    def pair(self, code: int) -> Pair:
        return self.name(code >> 32), self.name(code & 0xFFFFFFFF)


def _codes(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each symbol its pair with the next one as a number; -1 at the end of a word."""
    out = np.full(len(symbols), -1, np.int64)
    out[:-1] = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
    out[at[1:][at[1:] > at[:-1]] - 1] = -1
    return out


class Merges:
    """Merges in the order in which they were learned; each is done once, and a pair may come back later."""

    def __init__(self, pairs: list[Pair], symbols: Symbols):
        code = np.array([symbols.code(p) for p in pairs], np.int64)
        self.codes, of = np.unique(code, return_inverse=True)
        self.span = len(pairs) + 1
        self.steps = np.sort(of * self.span + np.arange(len(pairs)))
        self.made = np.array([symbols.number(a + b) for a, b in pairs], np.int32)

    def apply(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words, one behind the other, with all merges done. In each round every word does its next one."""
        if not len(self.codes) or not len(symbols):
            return symbols, at
        size = np.diff(at)
        which, done = np.arange(len(size)), np.full(len(size), -1)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            word = np.repeat(np.arange(len(size)), size)
            code = _codes(symbols, np.concatenate([[0], np.cumsum(size)]))
            of = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            k = np.searchsorted(self.steps, of * self.span + done[word] + 1)
            step = np.where(k < len(self.steps), self.steps[np.minimum(k, len(self.steps) - 1)] - of * self.span, self.span)
            step[(self.codes[of] != code) | (step >= self.span)] = self.span
            best = np.full(len(size), self.span)
            np.minimum.at(best, word, step)
            going = best < self.span
            ended = ~going[word]
            parts.append((which[~going], size[~going], symbols[ended]))
            if not going.any():
                break
            hit = np.flatnonzero((step == best[word]) & ~ended)
            if len(hit) > 1:  # of overlapping ones, as in aaa, every second from the left
                begun = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                hit = hit[(np.arange(len(hit)) - np.repeat(begun, np.diff(np.append(begun, len(hit))))) % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = self.made[step[hit]]
            gone = ended.copy()
            gone[hit + 1] = True
            size = (size - np.bincount(word[hit], minlength=len(size)))[going]
            symbols, which, done = symbols[~gone], which[going], best[going]
        which, size, symbols = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(which)
        begin = (np.cumsum(size) - size)[order]
        at = np.concatenate([[0], np.cumsum(size[order])])
        return symbols[np.arange(at[-1]) + np.repeat(begin - at[:-1], size[order])], at


class Replay:
    """Merges over stretches of heavy boundaries, exact while the best pair is certain.

    A symbol's last and first leaves are the symbols, as they were when the round began, that its ends can have come
    from. Boundaries that were not kept number at most `rest` for each pair of leaves that is not heavy.
    """

    def __init__(self, stretches: list[tuple[list[str], int]], heavy: set[Pair], rest: int, known: set[str]):
        self.heavy, self.rest, self.known = heavy, rest, known
        self.stretches = [s for s, _ in stretches]
        self.n = [n for _, n in stretches]
        self.counts: Counter = Counter()
        self.holders: dict[Pair, set[int]] = defaultdict(set)
        self.last: dict[str, set[str]] = {}
        self.first: dict[str, set[str]] = {}
        self.widest = [1, 1]
        for i, s in enumerate(self.stretches):
            for x in s:
                self.last[x], self.first[x] = {x}, {x}
            for p in zip(s, s[1:], strict=False):
                self.counts[p] += self.n[i]
                self.holders[p].add(i)
        self.heap = [self.entry(p) for p in self.counts]
        heapq.heapify(self.heap)

    def hidden(self, p: Pair) -> int:
        """How many more occurrences the pair can have where stretches were not kept."""
        return self.rest * sum((x, y) not in self.heavy for x in self.last[p[0]] for y in self.first[p[1]])

    def entry(self, p: Pair) -> tuple:
        return -(self.counts[p] + self.hidden(p)), p

    def best(self, least: int) -> Pair | None:
        """The pair of the largest count, smallest among equals; None where that is not certain any more."""
        while self.heap:
            top, p = self.heap[0]
            if self.counts[p] <= 0 or -top != self.counts[p] + self.hidden(p):  # an entry from before a merge
                heapq.heappop(self.heap)
                if self.counts[p] > 0:
                    heapq.heappush(self.heap, self.entry(p))
                continue
            certain = not self.hidden(p) and -top > self.rest * self.widest[0] * self.widest[1]
            return p if certain and -top >= least else None
        return None

    def grown(self, of: dict[str, set[str]], side: int, whole: str, part: str) -> bool:
        """Whether a symbol that existed has other leaves now, with the merge's."""
        start = {whole} if whole in self.known else set()
        before = of.get(whole, start)
        of[whole] = before | of[part]
        self.widest[side] = max(self.widest[side], len(of[whole]))
        return bool(before) and len(of[whole]) > len(before)

    def merge(self, a: str, b: str) -> None:
        whole, touched = a + b, set()
        more = [self.grown(self.last, 0, whole, b), self.grown(self.first, 1, whole, a)]
        for i in list(self.holders[a, b]):
            before = self.stretches[i]
            after = merged(before, a, b)
            for p in zip(before, before[1:], strict=False):
                self.counts[p] -= self.n[i]
                self.holders[p].discard(i)
                touched.add(p)
            for p in zip(after, after[1:], strict=False):
                self.counts[p] += self.n[i]
                self.holders[p].add(i)
                touched.add(p)
            self.stretches[i] = after
        if any(more):
            touched |= {p for p in self.counts if whole in p}
        for p in touched:
            if self.counts[p] > 0:
                heapq.heappush(self.heap, self.entry(p))


def learned(words: DataFrame, merges: int, alphabet: list[str] | None = None, least: int = 2, heavy: int = HEAVY, stretches: int = STRETCHES) -> list[Pair]:
    """The first so many merges over a table (word, n), most frequent pair first, smallest pair (left, then right, in
    code-point order) among equals, as long as it occurs `least` times.

    Characters outside the alphabet take no part. Null words and counts are left out, repeated words added up; an empty
    table gives no merges. Words are kept in cut form from round to round, on disk if memory is short.
    """
    symbols = Symbols()
    allowed = None if alphabet is None else np.array(sorted(map(ord, alphabet)), np.int32)
    state = _coded(words).persist(StorageLevel.MEMORY_AND_DISK)
    out: list[Pair] = []
    now = heavy if merges <= 0 or state.count() <= stretches else min(heavy, START)
    while len(out) < merges:
        pairs = _pair_counts(state, allowed).where(F.col("n") >= least)
        top = pairs.orderBy(F.desc("n")).limit(heavy + 1).collect()
        if not top:
            break
        if len(top) > heavy and top[0]["n"] == top[-1]["n"]:  # more equals than were taken
            ranked = [(_smallest(pairs.where(F.col("n") == top[0]["n"]), symbols), top[0]["n"])] * len(top)
        else:
            ranked = sorted(((symbols.pair(r["key"]), r["n"]) for r in top), key=lambda r: (-r[1], r[0]))
        done, now = _round(state, ranked, merges - len(out), symbols, least, heavy, min(heavy, now), stretches)
        out += done
        symbols.add(done)
        following = _rewritten(state, Merges(done, symbols)).persist(StorageLevel.MEMORY_AND_DISK)
        following.count()
        state.unpersist()
        state = following
        now *= 4  # the words that were too many for more pairs may fit now
    state.unpersist()
    return out


def _round(state: DataFrame, top: list[tuple[Pair, int]], wanted: int, symbols: Symbols, least: int, most: int, heavy: int, stretches: int) -> tuple[list[Pair], int]:
    """Merges of a round, and how many pairs were heavy; fewer than `most` where their stretches would be too many."""
    while True:
        rest = top[heavy][1] if len(top) > heavy else least - 1
        kept = {p for p, n in top[:heavy] if n > rest}
        if len(kept) < 2:  # the first is the best of all, whatever the others are
            return [top[0][0]], most if heavy == most else 2 * heavy
        rows = _stretches(state, np.array(sorted(symbols.code(p) for p in kept), np.int64)).limit(stretches + 1).toArrow()
        if rows.num_rows <= stretches:
            break
        heavy = max(1, len(kept) // 4)
    cut = [[symbols.name(x) for x in np.frombuffer(s, "<i4").tolist()] for s in rows.column("s").to_pylist()]
    replay = Replay(list(zip(cut, rows.column("n").to_pylist(), strict=True)), kept, rest, set(symbols.names))
    out: list[Pair] = [top[0][0]]
    replay.merge(*out[0])
    while len(out) < wanted and (p := replay.best(least)):
        replay.merge(*p)
        out.append(p)
    return out, heavy


def _binary(symbols: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(symbols, "<i4"))])


def _numbers(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A batch's words as numbers, and where each begins and the last ends."""
    if not len(c):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) // 4
    return np.frombuffer(data, "<i4", at[-1])[at[0] :], at - at[0]


def _longer(symbols: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(s, n) of the words that have a pair; the others have no more to say."""
    size = np.diff(at)
    keep = size > 1
    return pa.RecordBatch.from_arrays([_binary(symbols[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])), pa.array(n[keep])], ["s", "n"])


def _coded(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _longer(*_points(b.column(0)), b.column(1).to_numpy())

    some = words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL")
    return some.mapInArrow(run, "s binary, n long")


def _pair_counts(state: DataFrame, allowed: np.ndarray | None) -> DataFrame:
    """(key, n) of all pairs; characters outside the alphabet stay alone, so no longer symbol holds one."""

    def keys_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        symbols, at = _numbers(b.column(0))
        code, n = _codes(symbols, at), np.repeat(b.column(1).to_numpy(), np.diff(at))
        some = code >= 0
        if allowed is not None:
            known = (symbols >= LONGER) | np.isin(symbols, allowed)
            some &= known & np.append(known[1:], False)
        return code[some], n[some]

    return _summed(state, keys_of)


def _smallest(pairs: DataFrame, symbols: Symbols) -> Pair:
    """The first pair of a table in code-point order, left part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [min(map(symbols.pair, b.column(0).to_pylist())) for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in some], pa.string()) for k in (0, 1)], ["a", "b"])

    r = pairs.select("key").mapInArrow(run, "a string, b string").agg(F.min(F.struct("a", "b")).alias("p")).first()["p"]
    return r["a"], r["b"]


def _stretches(state: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(s, n): stretches of symbols with heavy boundaries, equal ones added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            symbols, at = _numbers(b.column(0))
            code = _codes(symbols, at)
            here = heavy[np.minimum(np.searchsorted(heavy, code), len(heavy) - 1)] == code
            before = np.concatenate([[False], here[:-1]])[: len(here)]
            begin, end = np.flatnonzero(here & ~before), np.flatnonzero(before & ~here)
            n = b.column(1).to_numpy()[np.searchsorted(at, begin, "right") - 1]
            yield pa.RecordBatch.from_arrays([_binary(symbols[here | before], np.concatenate([[0], np.cumsum(end - begin + 1)])), pa.array(n)], ["s", "n"])

    return state.mapInArrow(run, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n"))


def _rewritten(state: DataFrame, merges: Merges) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _longer(*merges.apply(*_numbers(b.column(0))), b.column(1).to_numpy())

    return state.mapInArrow(run, "s binary, n long")


def trained(words: DataFrame, vocabulary: int = VOCABULARY, coverage: float = COVERAGE) -> list[Pair]:
    """Merges of a set of `vocabulary` pieces, special ones and covered characters included."""
    words = words.select("word", "n").persist(StorageLevel.MEMORY_AND_DISK)
    alphabet = covered_characters(words, coverage)
    out = learned(words, max(0, vocabulary - SPECIAL - len(alphabet)), alphabet)
    words.unpersist()
    return out


def _named(numbers: np.ndarray, symbols: Symbols) -> pa.Array:
    distinct, of = np.unique(numbers, return_inverse=True)
    return pa.array([symbols.name(x) for x in distinct.tolist()], pa.string()).take(pa.array(of))


def in_pieces(words: DataFrame, merges: list[Pair]) -> DataFrame:
    """(word, pieces) of a table's distinct words."""
    symbols = Symbols(merges)
    done = Merges(merges, symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut, at = done.apply(*_points(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), _named(cut, symbols))], ["word", "pieces"])

    return words.select("word").where("word IS NOT NULL").distinct().mapInArrow(run, "word string, pieces array<string>")


def piece_counts(words: DataFrame, by: list[str], merges: list[Pair]) -> DataFrame:
    """(by, term, tf) from (by, word, n): each group is one long document of pieces, added up batch by batch."""
    symbols = Symbols(merges)
    done = Merges(merges, symbols)
    kinds = [words.schema[c] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[tuple, int] = {}
            keys = zip(*(c.to_pylist() for c in b.columns[:-2]), strict=True) if by else [()] * b.num_rows
            group = np.array([rows.setdefault(k, len(rows)) for k in keys], np.int64)
            cut, at = done.apply(*_points(b.column(len(by))))
            size = np.diff(at)
            key, tf = _totals(np.repeat(group, size) << 32 | cut, np.repeat(b.column(len(by) + 1).to_numpy(), size))
            columns = [pa.array([k[i] for k in rows], b.schema.field(i).type).take(pa.array(key >> 32)) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, _named(key & 0xFFFFFFFF, symbols), pa.array(tf)], [*by, "term", "tf"])

    made = [types.StructField("term", types.StringType()), types.StructField("tf", types.LongType())]
    some = words.select(*by, "word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL")
    return some.mapInArrow(run, types.StructType(kinds + made)).groupBy(*by, "term").agg(F.sum("tf").alias("tf"))


def piece_weights(words: DataFrame, by: list[str], merges: list[Pair]) -> DataFrame:
    """(by, term, w): TF-IDF of the groups over pieces."""
    counts = piece_counts(words, by, merges).persist(StorageLevel.MEMORY_AND_DISK)
    return T.weights(counts, counts, by)

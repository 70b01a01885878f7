"""Exact Jaccard self-join of shingle sets, by pivots, Voronoi regions and triangle-inequality windows.

Unrelated texts are all at distance 1 of each other and of every pivot, so pivots alone cannot tell them apart. A
first exact step therefore leaves out what no partner can reach: shingles are counted over all documents, each set is
ordered rarest shingle first, and sets at distance 0.2 or less must share one of the first fifth. The connected pieces
of that graph are the spaces that the metric join works in.

A space is cut over the cluster: pivots are drawn from it, its members meet them in blocks, each member belongs to the
region of its nearest pivot, and windows replicate boundary documents to every region where a partner may lie; regions
are spaces of the next round. A pivot has then met every member and leaves. What is linked to the same pivot, or to
pivots that are linked, is known to be connected; regions that are connected as a whole are done. Spaces of at most
LEAF_SETS sets are joined where they stand, in the same way.

The shingles cross the network once, packed: what is left of a shingle when its bucket is known, and its set's number
in the batch, make one integer, and a batch sends one sorted array to each bucket.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored, text_key, trimmed, utf8
from glossa.llm.components import Forest, components, dealt

SHINGLE = 5
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
BATCH_BYTES = 8 << 20
#: Sets of a batch are numbered in so many bits.
ORDINAL_BITS = 12
#: A space of more sets or bytes than this is cut into regions over the cluster; its members meet its pivots in blocks
#: of BLOCK_SETS. In a task, LEAF sets are compared with each other.
LEAF_SETS, LEAF_BYTES, BLOCK_SETS, LEAF = 256, 16 << 20, 128, 24
#: Pivots of a space in its first round, at most, eight times as many in each further one, and bytes of them in a task.
PIVOTS, PIVOT_BYTES = 64, 2 << 20
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
ORDINAL = np.uint64((1 << ORDINAL_BITS) - 1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


def shingles(text: bytes, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text; a text of fewer words is one shingle, of none has none."""
    ws = text.translate(LOWER).split()
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = len(h) - size + 1
    if n < 1:
        if not len(h):
            return h
        n, size = 1, len(h)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * MULTIPLIER + h[k : k + n]
    out ^= out >> np.uint64(31)
    out *= MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def needed(n: int, percent: int = PERCENT) -> int:
    """How many shingles a set of n shares with any partner at least."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int = PERCENT) -> int:
    """So many of its first shingles, in any order common to all sets, hold one that a partner has too."""
    return n - needed(n, percent) + 1


# ---- the metric join inside one space -----------------------------------------------------------------------------


class Space:
    """Sets (integer arrays without the shingles that only one set has) and their full sizes. Sets of equal labels are
    known to be connected."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT, labels: list | None = None):
        self.sizes, self.percent = sizes.astype(np.int64), percent
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        n = [len(x) for x in sets]
        self.entries, self.ends = ids, np.concatenate([[0], np.cumsum(n)])
        order = np.argsort(ids, kind="stable")
        self.holders = np.repeat(np.arange(len(sets)), n)[order]  # the sets of each shingle, shingle by shingle
        self.first = np.searchsorted(ids[order], np.arange(int(ids.max()) + 2 if len(ids) else 1))
        self.found = Forest()
        seen: dict = {}
        for i, x in enumerate(labels or []):
            self.found.join(i, seen.setdefault(x, i))

    def shared(self, p: int) -> np.ndarray:
        """Intersection sizes of set p with all sets, from the holders of its shingles."""
        mine = self.entries[self.ends[p] : self.ends[p + 1]]
        n = self.first[mine + 1] - self.first[mine]
        at = np.repeat(self.first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.holders[at], minlength=len(self.sizes))

    def distances(self, p: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances from p to the members, and which of them are linked to it."""
        both = self.shared(p)[members]
        union = self.sizes[p] + self.sizes[members] - both
        return 1 - both / np.maximum(1, union), 100 * both >= self.percent * union

    def visit(self, p: int, members: np.ndarray) -> np.ndarray:
        """The same distances; links are noted."""
        d, near = self.distances(p, members)
        for j in members[near].tolist():
            self.found.join(p, j)
        return d

    def outside(self, members: np.ndarray) -> np.ndarray:
        """Which members are not in the largest piece that is known to be connected."""
        roots = np.array([self.found.root(i) for i in members.tolist()])
        names, sizes = np.unique(roots, return_counts=True)
        return roots != names[sizes.argmax()]

    def join(self, members: np.ndarray) -> None:
        """Connect all members that are linked, in whatever way, by links between members. Pivots lie outside the
        largest connected piece; each has met all members when it leaves."""
        todo = [members]
        while todo:
            members = todo.pop()
            if len(members) < 2 or not (free := self.outside(members)).any():
                continue
            k = len(members) if len(members) <= LEAF else int(np.ceil(np.sqrt(len(members))))
            nearest, rows, used = np.full(len(members), 2.0), [], []
            for _ in range(k):  # each pivot is the one farthest from those before it
                p = int(np.argmax(np.where(free, nearest, -1.0)))
                if not free[p]:
                    break
                free[p] = False
                used.append(p)
                rows.append(self.visit(int(members[p]), members))
                nearest = np.minimum(nearest, rows[-1])
            d = np.stack(rows)
            rest = np.ones(len(members), bool)
            rest[used] = False
            regions = [members[r & rest] for r in windows(d, self.percent)]
            todo += regions if sum(map(len, regions)) <= 2 * len(members) else [members[rest]]


def windows(d: np.ndarray, percent: int) -> np.ndarray:
    """(pivot, member) -> whether the member goes to the pivot's region, from distances (pivot, member); the last row
    is the region of those that all pivots are far from.

    A pair within eps has d(x, p_j) <= d(x, p_i) + 2 eps, p_i being x's own pivot and p_j the other's: x is replicated
    to each region within that window. If one of them is nearer than 1 - eps to its own pivot, the other is nearer
    than 1 to it and goes there; else both are in the last region. So no one need go where it shares nothing.
    """
    best, eps = d.min(0), 1 - percent / 100
    return np.concatenate([(d <= best + 2 * eps + 1e-9) & (d < 1), [best >= 1 - eps - 1e-9]])


def connect(sets: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT, labels: list | None = None) -> list[int]:
    """For each set the number of the first set of its component."""
    space = Space(sets, sizes, percent, labels)
    space.join(np.arange(len(sets)))
    return [space.found.root(i) for i in range(len(sets))]


# ---- the distributed part -----------------------------------------------------------------------------------------


def batched(batches: Iterator[pa.RecordBatch], limit: int, rows: int) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= limit or len(texts) >= rows:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def shingle_lists(docs: DataFrame, buckets: int, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(key, n, ids, shared): a row per distinct set of a batch: its key, size and documents, and, rarest first, its
    shingles that other sets have too; null where so many are its own that no partner can exist."""
    kind = docs.schema[id_col].dataType.simpleString()
    bits = max(1, (buckets - 1).bit_length())
    top, up, low = np.uint64(64 - bits), np.uint64(bits), np.uint64(ORDINAL_BITS)
    frame = ["bucket", "batch", "header", "entries"]
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], frame)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part = _Hashes(), TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(batched(batches, BATCH_BYTES, 1 << ORDINAL_BITS)):
            at: dict[bytes, int] = {}
            keys, sets, owners = [], [], []
            for i, t in zip(ids, texts, strict=True):
                s = shingles(t, hashes, size)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                k = at.setdefault(key, len(keys))
                if k == len(keys):
                    keys.append(key)
                    sets.append(s)
                    owners.append([])
                owners[k].append(i)
            n = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate(sets)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], np.repeat(np.arange(len(sets), dtype=np.uint64), n)[order]
            to = (every >> top).astype(np.int64)
            packed = every << up & ~ORDINAL | owner
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            batch = part << 32 | number
            yield table([(batch % buckets, batch, pickle.dumps((keys, n, owners)), None), *[(int(to[a]), batch, None, packed[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]])
        del hashes
        trimmed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for bucket, batch, header, entries in zip(*(b.column(c).to_pylist() for c in frame), strict=True):
                if header is not None:
                    yield table([(bucket, batch, header, None)])
                else:
                    owner, parts = held.setdefault(bucket, ([], []))
                    owner.append(batch)
                    parts.append(np.frombuffer(entries, np.uint64))
        for bucket in list(held):
            owner, parts = held.pop(bucket)
            packed = np.concatenate(parts)
            names, which = np.unique(np.array(owner, np.int64), return_inverse=True)
            batch = np.repeat(which, [len(p) for p in parts])
            del parts
            order = np.argsort(packed >> low, kind="stable")
            packed, batch = packed[order], batch[order]
            start = np.flatnonzero(np.append(True, np.diff(packed >> low) != 0))
            many = np.diff(np.append(start, len(packed)))
            often = np.repeat(many, many)
            keep = often > 1
            packed, batch, often = packed[keep], batch[keep], np.minimum(often[keep], 0xFFFFFFFF).astype(np.uint32)
            order = np.argsort(batch, kind="stable")
            packed, batch, often = packed[order], batch[order], often[order]
            cuts = np.searchsorted(batch, np.arange(len(names) + 1))
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if b > a:
                    yield table([(bucket, int(names[k]), None, packed[a:b].tobytes() + often[a:b].tobytes())])
        trimmed()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(header: bytes, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
            keys, n, owners = pickle.loads(header)
            packed = [(np.uint64(b) << top, np.frombuffer(p[: len(p) // 12 * 8], np.uint64)) for b, p in parts]
            value = np.concatenate([b | p >> low << low >> up for b, p in packed] or [np.zeros(0, np.uint64)])
            owner = np.concatenate([p & ORDINAL for _, p in packed] or [np.zeros(0, np.uint64)]).astype(np.int64)
            often = np.concatenate([np.frombuffer(p[len(p) // 12 * 8 :], np.uint32) for _, p in parts] or [np.zeros(0, np.uint32)])
            order = np.lexsort((value, often, owner))
            value, owner = value[order], owner[order]
            cuts = np.searchsorted(owner, np.arange(len(keys) + 1)).tolist()
            lists = []
            for k, m in enumerate(n.tolist()):
                have = cuts[k + 1] - cuts[k]
                lists.append(value[cuts[k] : cuts[k + 1]].tobytes() if m and m - have < prefix(m, percent) else None)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(owners, pa.list_(ids_type)), pa.array(lists, pa.binary())], ["key", "n", "ids", "shared"])

        at, header, parts = None, None, []
        for b in batches:
            for bucket, batch, h, entries in zip(*(b.column(c).to_pylist() for c in frame), strict=True):
                if batch != at:
                    if header is not None:
                        yield one(header, parts)
                    at, header, parts = batch, None, []
                if h is not None:
                    header = h
                else:
                    parts.append((bucket, entries))
        if header is not None:
            yield one(header, parts)
        trimmed()

    from pyspark.sql.pandas.types import to_arrow_type

    ids_type = to_arrow_type(docs.schema[id_col].dataType)
    row = "bucket int, batch long, header binary, entries binary"
    sent = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(spread, row)
    back = sent.repartition("bucket").mapInArrow(count, row)
    return back.repartition("batch").sortWithinPartitions("batch").mapInArrow(gather, f"key binary, n long, ids array<{kind}>, shared binary")


def candidate_edges(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect all sets that share a shingle of their prefixes and are of near enough size.

    Sizes fall into classes by powers of 100 / percent, so that partners are in the same class or in neighbouring
    ones. Each stretch of rows is joined on the spot and sends one set for a shingle and class, however many have it;
    what is sent meets by shingle, once more a set for a stretch.
    """
    bounds = size_classes(percent)
    frame, types = ["shingle", "class", "key", "a", "b"], (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def out(found: Forest, sent: list[tuple] = ()) -> Iterator[pa.RecordBatch]:
        rows = [(s, c, found.root(k), None, None) for s, c, k in sent] + [(None, None, None, a, b) for a, b in found.edges()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], frame)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[pa.RecordBatch]:
            for (s, c), k in seen.items():
                if (other := seen.get((s, c + 1))) is not None:
                    found.join(k, other)
            yield from out(found, [(s, c, k) for (s, c), k in seen.items()])

        found, seen = Forest(), {}
        for b in batches:
            for key, n, shared in zip(*(b.column(c).to_pylist() for c in ("key", "n", "shared")), strict=True):
                c = bisect_right(bounds, n)
                for s in np.frombuffer(shared, np.int64)[: prefix(n, percent) - n + len(shared) // 8].tolist():
                    if (other := seen.setdefault((s, c), key)) is not key:
                        found.join(other, key)
                if len(seen) >= 150_000:
                    yield from sent()
                    found, seen = Forest(), {}
        yield from sent()

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last, held = Forest(), (None, 0), b""
        for b in batches:
            for s, c, key in zip(*(b.column(c).to_pylist() for c in frame[:3]), strict=True):
                if s == last[0] and c <= last[1] + 1 and key != held:
                    found.join(held, key)
                last, held = (s, c), key
                if len(found.up) >= 150_000:
                    yield from out(found)
                    found = Forest()
        yield from out(found)

    schema = "shingle long, class int, key binary, a binary, b binary"
    sent = stored(lists.select("key", "n", "shared").mapInArrow(near, schema), "stars")
    apart = sent.where("key IS NOT NULL").select(*frame).repartition("shingle").sortWithinPartitions("shingle", "class").mapInArrow(far, schema)
    return sent.where("key IS NULL").select("a", "b").union(apart.select("a", "b"))


def size_classes(percent: int) -> list[int]:
    """Where size classes begin: sizes of partners are at most a factor 100 / percent apart, hence in one class or in
    neighbouring ones."""
    step, at, out = Fraction(100, min(percent, 99)), Fraction(1), []
    while at < 1 << 40:
        at *= step
        out.append(-(-at.numerator // at.denominator))
    return out


ROW = "space binary, key binary, n long, shared binary, label binary"


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition, group by group, the first columns being the group's."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def joined_in_place(rows: DataFrame, percent: int) -> DataFrame:
    """(key, head) of small spaces: the set that stands for each set's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, 1):
            keys, sizes, sets, labels = (list(c) for c in zip(*held, strict=True))
            heads = connect([np.frombuffer(s, np.uint64) for s in sets], np.array(sizes), percent, labels)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([keys[h] for h in heads], pa.binary())], ["key", "head"])

    ordered = rows.select("space", "key", "n", "shared", "label").repartition("space").sortWithinPartitions("space", "key")
    return ordered.mapInArrow(run, "key binary, head binary")


def measured(rows: DataFrame) -> DataFrame:
    """(space, sets, bytes, main, others, small): what there is in a space, its most frequent label, and how many sets
    have another. Spaces of one label only are left out: they are connected."""
    each = rows.groupBy("space", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    sizes = each.groupBy("space").agg(F.sum("c").alias("sets"), F.sum("bytes").alias("bytes"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    return sizes.select("space", "sets", "bytes", F.col("top.label").alias("main"), (F.col("sets") - F.col("top.c")).alias("others"), ((F.col("sets") <= LEAF_SETS) & (F.col("bytes") <= LEAF_BYTES)).alias("small"))


def met_pivots(rows: DataFrame, percent: int, level: int) -> DataFrame:
    """(space, key, n, shared, label, near, regions) for the members of large spaces: the pivots that each is linked
    to, with their labels, and those whose regions it goes to; none for the pivots themselves.

    Pivots are drawn by hash from the sets outside the main label, about as many as wanted; a space from which none
    was drawn is one region. Members are dealt into blocks of about BLOCK_SETS, and the pivots are sent to each block.
    """
    luck = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    times = float(8 ** min(level, 6))
    most = F.least(F.lit(PIVOTS * times), F.ceil(F.col("sets") / (LEAF_SETS // 4)).cast("double") * times, F.lit(float(PIVOT_BYTES)) * F.col("sets") / F.greatest(F.col("bytes"), F.lit(1)))
    marked = rows.withColumn("pivot", (F.col("label") != F.col("main")) & (luck < F.greatest(F.lit(4.0), most) / F.col("others")))
    blocks = F.ceil(F.col("sets") / BLOCK_SETS).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks.cast("long")).cast("int")
    at = F.array(F.struct(own.alias("block"), F.lit(False).alias("visits")))
    sent = F.concat(at, F.when(F.col("pivot"), F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(x.alias("block"), F.lit(True).alias("visits")))).otherwise(F.array().cast("array<struct<block:int,visits:boolean>>")))
    base = ["key", "n", "shared", "label", "pivot"]
    dealt_out = marked.select("space", *base, F.explode(sent).alias("x")).select("space", "x.block", *base, "x.visits")
    names = ["space", "key", "n", "shared", "label", "near", "regions"]
    link = pa.list_(pa.struct([("key", pa.binary()), ("label", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (space, _), held in groups(batches, 2):
            pivots, members = [r for r in held if r[5]], [r for r in held if not r[5]]
            named = [*[r[0] for r in pivots], b""]
            for at in range(0, len(members), BLOCK_SETS):
                here = members[at : at + BLOCK_SETS]
                near, regions = [[] for _ in here], [[b""] for _ in here]
                if pivots:
                    every = pivots + here
                    met = Space([np.frombuffer(r[2], np.uint64) for r in every], np.array([r[1] for r in every]), percent)
                    who = np.arange(len(pivots), len(every))
                    d, linked = (np.stack(x) for x in zip(*(met.distances(p, who) for p in range(len(pivots))), strict=True))
                    goes = windows(d, percent)
                    near = [[{"key": pivots[p][0], "label": pivots[p][3]} for p in np.flatnonzero(linked[:, i]).tolist()] for i in range(len(here))]
                    regions = [[] if r[4] else [named[p] for p in np.flatnonzero(goes[:, i]).tolist()] for i, r in enumerate(here)]
                keys, sizes, sets, labels = (list(c) for c in list(zip(*here, strict=True))[:4])
                cols = [pa.array([space] * len(here), pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(labels, pa.binary()), pa.array(near, link), pa.array(regions, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names)

    ordered = dealt_out.repartition("space", "block").sortWithinPartitions("space", "block")
    return ordered.mapInArrow(run, f"{ROW}, near array<struct<key:binary,label:binary>>, regions array<binary>")


def relabelled(met: DataFrame) -> DataFrame:
    """(space, label, into): labels of a space that its pivots connect, each with the smallest of them.

    A member that is linked to several pivots connects their labels and, if others have its label too, that one. So
    there are no more different pairs than pairs of pivots and of pivots with labels of earlier pivots.
    """
    first = F.col("near")[0]["label"]
    pairs = met.where("size(near) > 0").select("space", first.alias("a"), F.explode(F.array_union(F.transform("near", lambda x: x["label"]), F.when(F.col("label") != F.col("key"), F.array("label")).otherwise(F.expr("cast(array() as array<binary>)")))).alias("b")).distinct()

    def run(key: tuple, held: pa.Table) -> pa.Table:
        found = Forest()
        for a, b in zip(held["a"].to_pylist(), held["b"].to_pylist(), strict=True):
            found.join(a, b)
        labels = list(found.up)
        return pa.table([pa.array([key[0].as_py()] * len(labels), pa.binary()), pa.array(labels, pa.binary()), pa.array([found.root(x) for x in labels], pa.binary())], ["space", "label", "into"])

    return pairs.groupBy("space").applyInArrow(run, "space binary, label binary, into binary")


def next_round(met: DataFrame) -> DataFrame:
    """The rows of the next round: each region is a space, or, where windows reach everywhere (more than two regions a
    member), the space as it is without its pivots."""
    into = stored(relabelled(met), "labels")
    reach = stored(met.groupBy("space").agg((F.sum(F.size("regions")) > 2 * F.count(F.lit(1))).alias("whole")), "reach")
    own = F.when(F.size("near") > 0, F.col("near")[0]["label"]).otherwise(F.col("label"))
    rest = met.where("size(regions) > 0").select("space", "key", "n", "shared", own.alias("label"), "regions")
    rest = rest.join(into, ["space", "label"], "left").withColumn("label", F.coalesce("into", "label")).join(reach, "space")
    rest = rest.withColumn("region", F.explode(F.when(F.col("whole"), F.array(F.lit(b""))).otherwise(F.col("regions"))))
    return rest.select(F.unhex(F.md5(F.concat("space", F.col("region")))).alias("space"), "key", "n", "shared", F.octet_length("shared").alias("bytes"), "label")


def linked(lists: DataFrame, spaces: DataFrame, percent: int) -> DataFrame:
    """(key, head): for each set of a space with a link, the set that stands for its component.

    Small spaces are joined in place, the others cut by new pivots, round by round. Spaces have nothing in common, so
    the first round's small ones are done; of those that were cut, the links are edges whose components are found
    once, at the end.
    """
    spaces = spaces.select(F.col("node").alias("key"), F.col("root").alias("space"))
    rows = lists.join(spaces, "key").select("space", "key", "n", "shared", "bytes", F.col("key").alias("label"))
    level, edges, heads = 0, None, None
    while True:
        sizes = stored(measured(rows), "sizes")
        small = joined_in_place(rows.join(sizes.where("small").select("space"), "space", "left_semi"), percent)
        if level == 0:
            heads = stored(small, "heads")
        else:
            edges = edges.unionByName(small.where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")))
        large = sizes.where("NOT small")
        if large.isEmpty():
            break
        met = stored(met_pivots(rows.drop("bytes").join(large, "space"), percent, level), "met")
        met = dealt(met, met.count(), 20_000)
        links = met.select("key", F.explode("near").alias("p")).select(F.col("key").alias("a"), F.col("p.key").alias("b")).where("a <> b")
        edges = links if edges is None else edges.unionByName(links)
        rows = stored(next_round(met), "spaces")
        rows = dealt(rows, rows.count(), 20_000)
        level += 1
    if edges is None:
        return heads
    return heads.unionByName(components(edges).select(F.col("node").alias("key"), F.col("root").alias("head")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per row; component_id is the smallest id reachable by links.

    Documents of equal sets are one set from the start. Null and empty texts have no shingles, link with nothing and
    keep their own id. Repeated ids are rows of their own; null ids are reached but never the smallest, unless a
    component has no other. Very long texts are sets like others, whole. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = stored(shingle_lists(docs, max(2, 4 * partitions), id_col, text_col, size, percent), "sets")
    lists = stored(table.where("shared IS NOT NULL").groupBy("key").agg(F.max("n").alias("n"), F.max("shared").alias("shared")).withColumn("bytes", F.octet_length("shared")), "lists")
    spaces = components(candidate_edges(lists, percent))
    heads = linked(lists, spaces, percent)
    smallest = table.where("n > 0").groupBy("key").agg(F.min(F.array_min("ids")).alias("least"))
    known = smallest.join(heads, "key", "left").withColumn("head", F.coalesce("head", "key"))
    least = known.groupBy("head").agg(F.min("least").alias("component_id"))
    to = known.join(least, "head").select("key", "component_id")
    bare = table.where("n = 0").select(F.explode("ids").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"))
    rows = table.where("n > 0").select("key", "n", "ids").join(to, "key")  # a row a batch, however many copies
    return rows.select(F.explode("ids").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").unionByName(bare.withColumn("component_id", F.col("doc_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked documents: the one of the smallest id (of equal ids, the smallest
    text key; of rows equal in both, the one that comes first as JSON). Documents without words link with nothing and
    stay, repeated or not. A null id comes after all others. Same columns, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(row.alias("row"), F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), text_key("text").alias("key")).alias("id"), F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    found = near_duplicates(whole.where("worded").select("id", F.col("row.text").alias("text")), id_col="id")
    kept = found.where(F.col("doc_id") == F.col("component_id"))
    keep = kept.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    keep = keep.select(F.col("id.key").alias("k"), F.col("id.doc_id").alias("i"), "rows")
    rows = whole.where("worded").join(keep, (F.col("id.key") == F.col("k")) & F.col("id.doc_id").eqNullSafe(F.col("i")))
    repeated = rows.where("rows > 1").groupBy("id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return whole.where("NOT worded").select("row").unionByName(rows.where("rows = 1").select("row")).unionByName(repeated).select("row.*")


def op10_jaccard_metric_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS sh FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM (SELECT * FROM s SEMI JOIN rare USING (sh)) a JOIN (SELECT * FROM s SEMI JOIN rare USING (sh)) b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(other) AS component_id FROM r GROUP BY id) m USING (doc_id)
"""

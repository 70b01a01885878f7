"""Removal of every byte that a repeated string of min_len bytes covers, over the whole corpus, exactly.

Each window of min_len bytes has an anchor: its smallest 16-byte hash. Equal windows have equal anchors at equal
offsets, so the anchors' hashes bring together every place where a repeat can lie. Consecutive windows of one anchor
form a run. A run that occurs twice as a whole is covered as a whole. The texts of the other runs whose anchor
occurs in different runs go to blocks, each anchor to one block, and each block builds an enhanced suffix array: its
common-prefix intervals, scanned with a stack and tested for diverse left neighbours, give the maximal repeats with all
their occurrences, whose spans are the bytes to remove.

Documents of equal text are one text from the start (all of it is covered, if it is long enough). A batch sends equal
runs once, whatever their number, so that a passage which a third of all documents hold reaches a task once a batch.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import text_key, utf8
from glossa.llm.repeats import EnhancedSuffixArray, RollingHash, mixed

MIN_BYTES = 200
GRAM = 16
#: Bytes of text hashed at a time, sent at a time, and of contents in a suffix array.
HASH_BYTES, SEND_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20, 1 << 20
#: An anchor with more contents than this is not given a suffix array.
GROUP_BYTES = 4 << 20
RUN = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("k0", "<u8"), ("k1", "<u8"), ("start", "<u4"), ("n", "<u2"), ("twice", "?")])
NEED = np.dtype([("anchor", "<u8"), ("start", "<u4"), ("n", "<u2"), ("whole", "?")])
FULL = np.dtype([("start", "<u4"), ("end", "<u4")])
EMPTY = np.zeros(0, RUN)


def anchors(data: np.ndarray, ends: np.ndarray, hasher: RollingHash, min_len: int) -> tuple[np.ndarray, ...]:
    """Runs of the texts that end at `ends` in data: first window, number of windows, anchor hash, content hash.

    The smallest of 185 hashes has small leading bits, so it is hashed once more: anchors are dealt by leading bits."""
    none = np.zeros(0, np.int64)
    if len(data) < min_len:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = hasher.sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = mixed(hasher.of(sums, at, at + GRAM))
    bits = np.uint64(max(22, len(data).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = gram & ~low | at.astype(np.uint64)  # the leftmost of equal hashes wins
    width = min_len - GRAM + 1
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    anchor = (key & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    inside = np.arange(len(anchor)) + min_len <= ends[np.minimum(text, len(ends) - 1)]
    new = np.append(True, (np.diff(anchor) != 0) | (np.diff(text) != 0))
    start = np.flatnonzero(new & inside)
    if not len(start):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    stop = np.flatnonzero(np.append(new[1:], True) & inside | inside & ~np.append(inside[1:], False))
    count = stop - start + 1
    p = anchor[start]
    content = mixed(hasher.of(sums, start, stop + min_len) + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (p - start).astype(np.uint64))
    return start, count, mixed(gram[p]), content


def by_key(rows: np.ndarray) -> Iterator[tuple[bytes, np.ndarray]]:
    """Rows of a table with k0 and k1, key by key."""
    rows = rows[np.lexsort((rows["k1"], rows["k0"]))]
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(rows["k0"]) != 0) | (np.diff(rows["k1"]) != 0)) + 1, [len(rows)]]) if len(rows) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield rows["k0"][a].tobytes() + rows["k1"][a].tobytes(), rows[a:b]


def full(rows: np.ndarray, min_len: int) -> bytes:
    out = np.empty(len(rows), FULL)
    out["start"], out["end"] = rows["start"], rows["start"].astype(np.int64) + rows["n"] + min_len - 1
    return out.tobytes()


def grouped(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs by anchor and content; where a content begins; how often it occurs; for each run its content's number."""
    runs = runs[np.lexsort((runs["content"], runs["anchor"]))]
    new = np.append(True, (np.diff(runs["anchor"]) != 0) | (np.diff(runs["content"]) != 0))
    first, which = np.flatnonzero(new), np.cumsum(new) - 1
    return runs, first, np.bincount(which, weights=1 + runs["twice"]), which


def repeated_spans(contents: list[bytes], min_len: int, hashers: list[RollingHash]) -> list[list[tuple[int, int]]]:
    """Spans of each content that repeats cover. One block is one suffix array; a single anchor's contents beyond
    GROUP_BYTES would make too large a one, and there the windows' 128-bit hashes are compared instead."""
    if sum(map(len, contents)) <= GROUP_BYTES:
        return EnhancedSuffixArray(contents, min_len, hashers[0]).covered()
    keys, owner, start = [], [], []
    for i, c in enumerate(contents):
        data, at = np.frombuffer(c, np.uint8), np.arange(len(c) - min_len + 1)
        keys.append(np.stack([h.of(h.sums(data), at, at + min_len) for h in hashers], 1))
        owner.append(np.full(len(at), i, np.int32))
        start.append(at.astype(np.int32))
    keys, owner, start = np.concatenate(keys), np.concatenate(owner), np.concatenate(start)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    same = np.append(False, (keys[order[1:]] == keys[order[:-1]]).all(1))
    again = np.sort(order[same | np.append(same[1:], False)])
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    for i, a in zip(owner[again].tolist(), start[again].tolist(), strict=True):
        if out[i] and a <= out[i][-1][1]:
            out[i][-1] = (out[i][-1][0], a + min_len)
        else:
            out[i].append((a, a + min_len))
    return out


def removal(texts: DataFrame, min_len: int) -> DataFrame:
    """(key, text, copies, spans): for each distinct text the pieces that cover what is to be removed, unmerged."""
    spark = texts.sparkSession
    buckets = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shift = np.uint64(64 - (buckets - 1).bit_length())
    wire = "bucket int, runs binary, key binary, full binary"
    names = ["bucket", "runs", "key", "full"]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    table = lambda rows, t=types, n=names: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), t, strict=True)], n)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()

        def hashed(keys: list[bytes], held: list[bytes], copies: list[int]) -> np.ndarray:
            ends = np.cumsum([len(t) for t in held])
            start, n, anchor, content = anchors(np.frombuffer(b"".join(held), np.uint8), ends, hasher, min_len)
            text = np.searchsorted(ends, start, side="right")
            out = np.empty(len(start), RUN)
            k = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            out["anchor"], out["content"], out["k0"], out["k1"] = anchor, content, k[text, 0], k[text, 1]
            out["start"], out["n"], out["twice"] = start - (ends - [len(t) for t in held])[text], n, (np.array(copies) > 1)[text]
            return out

        def sent(runs: np.ndarray) -> Iterator[pa.RecordBatch]:
            runs, first, often, which = grouped(runs)
            again = runs[(often[which] > 1) & ~runs["twice"]]  # copied texts are removed whole anyway
            once = runs[first]
            once["twice"] = often > 1
            to = (once["anchor"] >> shift).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            rows = [(int(to[x]), once[x:y].tobytes(), None, None) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if y > x]
            rows += [(k[0] % buckets, None, k, full(r, min_len)) for k, r in by_key(again)]
            if rows:
                yield table(rows)

        keys, held, copies, size, done, total = [], [], [], 0, [], 0
        for b in batches:
            for k, t, c in zip(b.column(0), b.column(1), b.column(2), strict=True):
                t = t.as_py()
                if len(t) < min_len:
                    continue
                keys.append(k.as_py())
                held.append(t)
                copies.append(c.as_py())
                size += len(t)
                if size >= HASH_BYTES:
                    done.append(hashed(keys, held, copies))
                    total += size
                    keys, held, copies, size = [], [], [], 0
                    if total >= SEND_BYTES:
                        yield from sent(np.concatenate(done))
                        done, total = [], 0
        if held:
            done.append(hashed(keys, held, copies))
        if done:
            yield from sent(np.concatenate(done))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            runs, keys, fulls = (b.column(i).to_pylist() for i in (1, 2, 3))
            found += [r for r in runs if r is not None]
            if rows := [(k, f, None) for k, f in zip(keys, fulls, strict=True) if k is not None]:
                yield table(rows, types[1:], ["key", "full", "need"])
        if not found:
            return
        runs, first, often, which = grouped(np.concatenate([np.frombuffer(r, RUN) for r in found]))
        head = runs[first]
        several = np.append(True, np.diff(head["anchor"]) != 0)
        kinds = np.bincount(np.cumsum(several) - 1)[np.cumsum(several) - 1]  # contents of this anchor
        again = runs[often[which] > 1]
        need = head[kinds > 1]
        whole = (often > 1)[kinds > 1]
        rows = [(k, full(r, min_len), None) for k, r in by_key(again)]
        if len(need):
            out = np.empty(len(need), np.dtype(NEED.descr + [("k0", "<u8"), ("k1", "<u8")]))
            for c in ("anchor", "start", "n", "k0", "k1"):
                out[c] = need[c]
            out["whole"] = whole
            rows += [(k, None, np.ascontiguousarray(r[list(NEED.names)].astype(NEED)).tobytes()) for k, r in by_key(out)]
        for a in range(0, len(rows), 10_000):
            yield table(rows[a : a + 10_000], types[1:], ["key", "full", "need"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[int, list] = {}
            for key, text, needs in zip(*(b.column(c).to_pylist() for c in ("key", "text", "needs")), strict=True):
                for need in needs:
                    for anchor, start, n, whole in np.frombuffer(need, NEED).tolist():
                        out.setdefault(anchor >> int(shift), []).append((anchor, key, start, whole, text[start : start + n + min_len - 1]))
            rows = [(k, pickle.dumps(v, 5)) for k, v in out.items()]
            if rows:
                yield table(rows, types[:2], ["bucket", "contents"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [RollingHash(1), RollingHash(2)]
        rows = ((k, blob.as_py()) for b in batches for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for _, blobs in groupby(rows, key=lambda r: r[0]):
            yield from searched(sorted((c for _, blob in blobs for c in pickle.loads(blob)), key=lambda c: c[0]), hashers)

    def searched(held: list[tuple], hashers: list[RollingHash]) -> Iterator[pa.RecordBatch]:
        ahead: dict[int, int] = {}
        for c in held:
            ahead[c[0]] = ahead.get(c[0], 0) + len(c[4])

        def block(part: list) -> Iterator[pa.RecordBatch]:
            rows = []
            for (_, key, start, whole, _), spans in zip(part, repeated_spans([c[4] for c in part], min_len, hashers), strict=True):
                if spans and not whole:
                    out = np.array([(start + a, start + b) for a, b in spans], FULL)
                    rows.append((key, out.tobytes()))
            if rows:
                yield table(rows, types[2:], ["key", "full"])

        at, size = 0, 0
        for i, c in enumerate(held):
            if c[0] != held[i - 1][0] and size + ahead[c[0]] > BLOCK_BYTES and i > at:
                yield from block(held[at:i])
                at, size = i, 0
            size += len(c[4])
        if at < len(held):
            yield from block(held[at:])

    runs = texts.mapInArrow(runs_of, wire).repartition("bucket")
    judged = runs.mapInArrow(judge, "key binary, full binary, need binary").groupBy("key").agg(F.collect_list("full").alias("fulls"), F.collect_list("need").alias("needs"))
    asked = texts.select("key", "text").join(judged.where("size(needs) > 0").select("key", "needs"), "key")
    covers = asked.select("key", "text", "needs").mapInArrow(contents, "bucket int, contents binary").repartition(buckets // 4, "bucket").sortWithinPartitions("bucket").mapInArrow(search, "key binary, full binary").groupBy("key").agg(F.collect_list("full").alias("more"))
    empty = F.expr("cast(array() as array<binary>)")
    return texts.join(judged.select("key", "fulls"), "key", "left").join(covers, "key", "left").select("key", "text", "copies", F.concat(F.coalesce("fulls", empty), F.coalesce("more", empty)).alias("spans"))


def merged(n: int, copies: int, spans: list[bytes], min_len: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of n bytes."""
    if copies > 1 and n >= min_len:
        return [(0, n)]
    if not spans:
        return []
    rows = np.concatenate([np.frombuffer(s, FULL) for s in spans])
    rows = rows[np.argsort(rows["start"], kind="stable")]
    reach = np.maximum.accumulate(rows["end"])
    new = np.append(True, rows["start"][1:] > reach[:-1])
    return list(zip(rows["start"][new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(rows) - 1)].tolist(), strict=True))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, text, copies): equal texts once; counted before they cross the network."""
    return docs.select(text_key(text_col).alias("key"), utf8(text_col).alias("text")).groupBy("key").agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def deduplicated(docs: DataFrame, min_len: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): a row per row.

    A null text is empty. Strings are judged on the input; matches never cross documents. Repeated rows are copies of
    each other; null ids stay; an empty table gives an empty result; other columns are ignored.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            cols = [[], [], [], [], []]
            for text, copies, spans in zip(*(b.column(c) for c in ("text", "copies", "spans")), strict=True):
                text = text.as_py()
                gone = merged(len(text), copies.as_py(), spans.as_py(), min_len)
                kept = [text[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)], strict=True)]
                for c, v in zip(cols, (len(text), sum(e - s for s, e in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": s, "end": e} for s, e in gone]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind), strict=True))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = removal(distinct_texts(docs, text_col), min_len).mapInArrow(cut, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key")).join(done, "key").drop("key")


def op2_interval_tree_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")

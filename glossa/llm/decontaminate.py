"""Benchmark decontamination: an FM-index per training shard, searched backward for every test phrase.

A phrase is a window of consecutive words of a benchmark item. Words that no item has become one separator: no phrase
can hold them. Each task builds indexes of bounded size over its documents, so nothing is exchanged; the phrases are
sent to the tasks in blocks of bounded size, and the spans found by several blocks are merged per text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import by_place, forgotten, text_key, trimmed, utf8, word_table
from glossa.llm.fm_index import FMIndex

WORDS = word_table(keep_digits=True)
WINDOW = 10
SHARD_WORDS = 1_000_000
#: Bytes of benchmark text that are sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
HITS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Phrases:
    """The windows of some items as rows of vocabulary numbers, by length, and which items each is of."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        found: dict[int, dict[tuple, set[int]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(number[item])
        self.by_length = []
        for size, rows in sorted(found.items()):
            owners = [sorted(s) for s in rows.values()]
            ends = np.cumsum([0, *map(len, owners)])
            self.by_length.append((size, np.array(list(rows), np.int64).reshape(-1, size), ends, np.concatenate([np.array(o, np.int64) for o in owners])))

    def occurrences(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """For each text: its number of words, the merged spans of hit words, and the items with a window in it."""
        get = self.vocabulary.get
        lines = [words(t) for t in texts]
        counts = np.array([len(x) for x in lines], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts + 1)])
        symbols = np.zeros(int(starts[-1]), np.int32)
        for at, ws in zip(starts.tolist(), lines, strict=False):
            symbols[at : at + len(ws)] = np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[list[str]] = [[] for _ in texts]
        if not self.by_length or not symbols.any():
            return counts, spans, items
        keep = symbols != 0
        keep[1:] |= keep[:-1]  # one separator after each run of known words
        place = np.flatnonzero(keep)
        index = FMIndex(symbols[place])
        edge = np.zeros(len(place) + 1, np.int32)
        pairs = [np.zeros((0, 2), np.int64)]
        for size, rows, ends, owners in self.by_length:
            which, lo, hi = index.search(rows)
            for a in range(0, len(which), 4096):
                w, first, many = which[a : a + 4096], lo[a : a + 4096], hi[a : a + 4096] - lo[a : a + 4096]
                at = index.locate(np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum()))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                doc = np.searchsorted(starts, place[at], side="right") - 1
                seen = np.unique(np.stack([doc, np.repeat(w, many)], 1), axis=0)
                n = ends[seen[:, 1] + 1] - ends[seen[:, 1]]
                own = owners[np.repeat(ends[seen[:, 1]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                pairs.append(np.stack([np.repeat(seen[:, 0], n), own], 1))
        hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        begin, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
        for a, b in zip(place[begin].tolist(), (place[end - 1] + 1).tolist(), strict=True):
            doc = int(np.searchsorted(starts, a, side="right")) - 1
            spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
        for doc, item in np.unique(np.concatenate(pairs), axis=0).tolist():
            items[doc].append(self.items[item])
        return counts, spans, items


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[Phrases]:
    """Benchmark items in blocks of about block_bytes; a null text has no words, a null id is written "null"."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), utf8("text").alias("text")).where("octet_length(text) > 0")
    blocks, held, size = [], [], 0
    for r in rows.toLocalIterator():
        held.append((r["item_id"], bytes(r["text"])))
        size += len(held[-1][1])
        if size >= block_bytes:
            blocks.append(Phrases(held, window))
            held, size = [], 0
    return [*blocks, Phrases(held, window)] if held or not blocks else blocks


def shards(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the input of about SHARD_WORDS words (six bytes each), with their texts."""
    for b in batches:
        sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in b.column(column)])
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 6 * SHARD_WORDS, side="right"))
            part = b.slice(at, max(1, end - at))
            yield part, [t or b"" for t in part.column(column).to_pylist()]
            at += part.num_rows


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items): merged spans of hit words and the items that have a window in the document.

    Rows stay rows (repeated, null ids too); null texts have no words; an empty benchmark hits nothing.
    """
    blocks = phrase_blocks(benchmark, window, block_bytes)
    sc = docs.sparkSession.sparkContext

    def finder(block: Phrases, key: str, kind: str):
        sent = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in shards(batches, 1):
                counts, spans, items = sent.value.occurrences(texts)
                found = [[{"start": a, "end": b} for a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, ARROW_SPANS), pa.array(items, pa.list_(pa.string()))], [key, "n_words", "spans", "items"])

        return lambda df: df.mapInArrow(run, f"{key} {kind}, {HITS}")

    if len(blocks) == 1:
        kind = docs.schema[id_col].dataType.simpleString()
        return finder(blocks[0], "doc_id", kind)(docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")))
    texts = docs.select(text_key(text_col).alias("key"), utf8(text_col).alias("text"))
    found = None
    for b in blocks:
        df = finder(b, "key", "binary")(texts)
        found = df if found is None else found.unionByName(df)
    n = len(blocks)
    merged = found.dropDuplicates().groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # n rows a key
    assert n > 1
    united = F.aggregate(F.array_sort("spans"), F.expr("cast(array() as array<struct<start:int,end:int>>)"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))))
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key")).join(merged, "key").select("doc_id", "n_words", united.alias("spans"), "items")


def report(found: DataFrame) -> DataFrame:
    ids = F.array_sort("items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without its words first..end-1 of each span, and without what stands between words of one span."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORDS))] if spans else []
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join(out) + text[last:]


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with every hit span cut out of its text (and n_chars set anew where there is one); documents left without
    a word are dropped if something was cut from them, all others stay. Same columns, whatever their names: null texts
    stay null, repeated rows are treated alike, a text of any length is cut as a whole, ties do not arise, and an empty
    table or benchmark changes nothing."""
    blocks = phrase_blocks(benchmark, window, block_bytes)
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        for whole in batches:
            raw = whole.set_column(at, "text", whole.column(at).cast(pa.binary()))
            for part, texts in shards(iter([raw]), at):
                marks = [np.zeros(0, np.int64)] * len(texts)
                for s in sent:
                    for i, found in enumerate(s.value.occurrences(texts)[1]):
                        if found:
                            marks[i] = np.union1d(marks[i], np.concatenate([np.arange(a, b) for a, b in found]))
                new, keep = part.column(at).to_pylist(), np.ones(len(texts), bool)
                for i, m in enumerate(marks):
                    if len(m):
                        gaps = np.flatnonzero(np.diff(m) > 1)
                        spans = list(zip(m[np.append(0, gaps + 1)].tolist(), (m[np.append(gaps, len(m) - 1)] + 1).tolist(), strict=True))
                        new[i] = cut(texts[i], spans)
                        keep[i] = bool(words(new[i]))
                out = part.set_column(at, "text", pa.array([None if t is None else t.decode() for t in new], pa.string()))
                if size is not None:
                    old = part.column(size).to_pylist()
                    out = out.set_column(size, "n_chars", pa.array([len(new[i].decode()) if len(m) else old[i] for i, m in enumerate(marks)], part.schema.field(size).type))
                yield out.filter(pa.array(keep)).rename_columns(names)
        trimmed()

    names = docs.columns
    return by_place(docs).mapInArrow(run, docs.schema)


def op3_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(hits(docs, benchmark))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) CROSS JOIN (SELECT DISTINCT k FROM bw) WHERE i + k - 1 <= len(ws)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade >= k | x) = sigmoid(w.x - threshold_k): one weight vector, ordered thresholds. Features are the distinct words
of a text and the distinct beginnings of its words, which catch inflected forms that the sample lacks. Fitted on a bounded sample of labelled documents; every document is scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import by_place, forgotten, stored, trimmed, utf8, word_table

WORDS = word_table(keep_digits=False)
#: The fit reads this many labelled documents at most, taken by a hash of their ids, each in full.
MAX_TRAIN_DOCS = 8000


def words(text: bytes) -> list[bytes]:
    """Letter runs, A-Z lower-cased; bytes beyond ASCII are letters."""
    return text.translate(WORDS).split()


def features(text: bytes) -> set[bytes]:
    """Distinct words, and their first four to seven bytes where a word is longer."""
    found = set(words(text))
    return found.union(*[{w[:n] + b"-" for w in found if len(w) > n} for n in (4, 5, 6, 7)])


@dataclass
class OrdinalModel:
    weights: dict[bytes, float]
    thresholds: list[float]  # ascending, one for each grade from 1

    def grades(self, text: bytes) -> list[float]:
        """P(grade >= k) for k from 1."""
        get = self.weights.get
        score = sum([get(w, 0.0) for w in features(text)])
        return [1 / (1 + np.exp(-max(-60.0, min(60.0, score - t)))) for t in self.thresholds]


def severity(texts: list[list[bytes]], toxic: np.ndarray, n_grades: int = 3, min_docs: int = 4, purity: float = 0.8) -> np.ndarray:
    """Grades from labels that only say toxic or not: 0 if not; else 1 and more by how many markers a text holds
    (features of min_docs texts of which a share of `purity` is toxic), in equal parts of the toxic texts."""
    seen: dict[bytes, list[int]] = {}
    for ws, bad in zip(texts, toxic.tolist(), strict=True):
        for w in ws:
            c = seen.setdefault(w, [0, 0])
            c[0] += 1
            c[1] += bad > 0
    markers = {w for w, (n, bad) in seen.items() if n >= min_docs and bad >= purity * n}
    held = np.array([sum(w in markers for w in ws) for ws in texts])
    out = (toxic > 0).astype(np.int64)
    if out.any():
        cuts = np.quantile(held[out > 0], np.arange(1, n_grades - 1) / (n_grades - 1))
        out[out > 0] += np.searchsorted(cuts, held[out > 0], side="left")
    return out


def fit(texts: list[list[bytes]], grades: np.ndarray, n_grades: int = 3, min_docs: int = 4, min_g: float = 15.0, l1: float = 5e-5, l2: float = 1e-4, steps: int = 400) -> OrdinalModel:
    """Accelerated proximal gradient ascent on the mean log-likelihood of the grades, each weight with a step of its
    own from a bound on the curvature; the L1 part keeps the weights sparse.

    Features of fewer than min_docs texts, or whose log-likelihood ratio against grade 0 is below min_g, are left
    out first. Thresholds are kept in order by their gaps. Grades without any row share the next threshold's estimate.
    """
    vocabulary: dict[bytes, int] = {}
    counts: list[int] = []
    rows, cols = [], []
    for i, ws in enumerate(texts):
        for w in ws:
            j = vocabulary.setdefault(w, len(counts))
            if j == len(counts):
                counts.append(0)
            counts[j] += 1
            rows.append(i)
            cols.append(j)
    n = max(1, len(texts))
    row, col, total = (np.asarray(x, dtype=np.int64) for x in (rows, cols, counts))
    seen = np.bincount(col, weights=(grades > 0)[row], minlength=len(total)) if len(col) else np.zeros(0)
    want = total * float(np.mean(grades > 0) if len(grades) else 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.nan_to_num(seen * np.log(seen / want)) + np.nan_to_num((total - seen) * np.log((total - seen) / (total - want))))
    keep = (total >= min_docs) & (ratio >= min_g)
    new = np.cumsum(keep) - 1
    if len(col):
        use = keep[col]
        row, col = row[use], new[col[use]]
    d = int(keep.sum())
    w = np.zeros(d)
    k = n_grades - 1
    rates = np.array([((grades >= g).sum() + 0.5) / (n + 1) for g in range(1, n_grades)])
    first, gaps = -np.log(rates[0] / (1 - rates[0])), np.maximum(0.05, -np.diff(np.log(rates / (1 - rates))))
    above = np.stack([grades >= g for g in range(1, n_grades)], 1) if len(grades) else np.zeros((0, k), bool)
    active = np.bincount(row, minlength=n)[:n] + k + 1 if d else np.full(n, k + 1)
    step = 1 / (0.5 * np.bincount(col, weights=active[row], minlength=d) / n + l2) if d else np.zeros(0)
    cut_step = 1 / (0.5 * active.mean())
    old_w, old_first, old_gaps, t = w, first, gaps, 1.0
    for _ in range(steps):
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        push = (before - 1) / t
        at_w, at_first, at_gaps = w + push * (w - old_w), first + push * (first - old_first), np.maximum(0.01, gaps + push * (gaps - old_gaps))
        old_w, old_first, old_gaps = w, first, gaps
        cuts = at_first + np.concatenate([[0.0], np.cumsum(at_gaps)])
        z = np.bincount(row, weights=at_w[col], minlength=n)[:n] if d else np.zeros(n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -60, 60)))  # P(grade >= g)
        upper = np.concatenate([np.ones((n, 1)), p], 1)
        lower = np.concatenate([p, np.zeros((n, 1))], 1)
        at = above.sum(1) if len(grades) else np.zeros(n, int)
        i = np.arange(n)
        up, lo = upper[i, at], lower[i, at]
        mass = np.maximum(up - lo, 1e-12)
        d_up, d_lo = up * (1 - up), lo * (1 - lo)
        dz = -(d_up - d_lo) / mass / n
        g_cut = np.zeros(k)
        np.add.at(g_cut, np.minimum(at, k) - 1, np.where(at > 0, d_up / mass / n, 0.0))
        np.add.at(g_cut, np.minimum(at, k - 1), np.where(at < k, -d_lo / mass / n, 0.0))
        if d:
            w = at_w - step * (np.bincount(col, weights=dz[row], minlength=d) + l2 * at_w)
            w = np.sign(w) * np.maximum(0.0, np.abs(w) - step * l1)
        first = at_first - cut_step * g_cut.sum()
        gaps = np.maximum(0.01, at_gaps - cut_step * np.cumsum(g_cut[::-1])[::-1][1:])
    cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
    names = [x for x, ok in zip(vocabulary, keep, strict=True) if ok]
    return OrdinalModel({x: float(v) for x, v in zip(names, w, strict=True) if v}, [float(c) for c in cuts])


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc_id, words, toxic) of a bounded sample. Rows with a null id or label are left out; of several labels of a
    document the worst counts."""
    graded = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", utf8("text").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [b" ".join(sorted(features(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary()), b.column("toxic").cast(pa.int32())], ["doc_id", "words", "toxic"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words binary, toxic int")


def screened(sample: DataFrame, min_docs: int, min_g: float) -> list[bytes]:
    """Features of a sample that at least min_docs texts have and that tell toxic from not by min_g or more; counted
    on the cluster, so that only they come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [w.split() for w in b.column("words").to_pylist()]
            marks = np.repeat(b.column("toxic").to_numpy(zero_copy_only=False), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array([w for x in lists for w in x], pa.binary()), pa.array(marks, pa.int32())], ["feature", "toxic"])

    n, bad = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n:
        return []
    c, t = F.col("n").cast("double"), F.col("t").cast("double")
    part = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(0.0)
    ratio = 2 * (part(t, c * (bad / n)) + part(c - t, c * (1 - bad / n)))
    counts = sample.mapInArrow(run, "feature binary, toxic int").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    return [bytes(r["feature"]) for r in counts.where((c >= min_docs) & (ratio >= min_g)).select("feature").orderBy("feature").collect()]


def fit_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, min_docs: int = 4, min_g: float = 15.0, **options) -> OrdinalModel:
    """Fit on at most max_docs labelled documents; on none, nothing is toxic. Of several texts under one id the one whose
    features come first in byte order counts, so that a fit can be repeated."""
    rows = training_rows(docs, labels, max_docs)
    sample = stored(rows.groupBy("doc_id").agg(F.min(F.struct("words", "toxic")).alias("x")).select("doc_id", "x.words", "x.toxic"), "labelled")
    kept = docs.sparkSession.sparkContext.broadcast(frozenset(screened(sample, min_docs, min_g)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [b" ".join([w for w in x.split() if w in kept.value]) for x in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary()), b.column("toxic")], b.schema.names)

    rows = sample.mapInArrow(run, sample.schema).orderBy("doc_id").collect()  # max_docs rows of few features
    if not rows:
        return OrdinalModel({}, [10.0, 11.0])
    texts = [bytes(r["words"]).split() for r in rows]
    return fit(texts, severity(texts, np.array([r["toxic"] for r in rows])), min_docs=min_docs, min_g=min_g, **options)


def score_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_toxic, p_severe, expected_severity, toxic): every whole text scored; toxic where grade 1 or more is
    the likelier (a tie is toxic). Null and empty texts have no features. A row for each row, ids as they are, repeated and
    null ones included; texts of any length are scored whole; an empty table gives an empty result; other columns,
    whatever their names, are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            p = np.array([m.grades(t.as_py()) for t in b.column(1)]).reshape(-1, len(m.thresholds))
            cols = [pa.array(np.round(x, 6), pa.float64()) for x in (p[:, 0], p[:, -1], p.sum(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(p[:, 0] >= 0.5, pa.bool_())], ["doc_id", "p_toxic", "p_severe", "expected_severity", "toxic"])

    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, p_toxic double, p_severe double, expected_severity double, toxic boolean")


def accept(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs that are not toxic, columns as they are, whatever their names; decided text by text, in the scan
    itself, however long a text is. Null and empty texts have no features and stay; repeated rows are decided alike; an
    empty table stays empty."""
    sent, names, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        m = sent.value
        for b in batches:
            yield b.filter(pa.array([m.grades((t.as_py() or "").encode())[0] < 0.5 for t in b.column(at)], pa.bool_())).rename_columns(names)
        trimmed()

    return by_place(docs).mapInArrow(run, docs.schema)


def op4_ordinal_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, fit_documents(docs, labels))

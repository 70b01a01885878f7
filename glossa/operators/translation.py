"""Machine-translation metrics from additive per-sentence statistics, and their paired bootstrap."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAR_ORDER, WORD_ORDER, BETA, BLEU_ORDER = 6, 2, 2.0, 4


PUNCTUATION = frozenset(string.punctuation)
#: The published plain-text tokenisation for BLEU: what is set apart, in this order.
APART = [
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def chrf_words(text: str) -> list[str]:
    """White-space words, one punctuation mark at the end split off, or else one at the beginning."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def bleu_words(text: str) -> list[str]:
    """Words of the 13a kind: entities decoded, punctuation apart, full stops and commas kept within numbers."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, char)
    text = f" {text} "
    for pattern, by in APART:
        text = pattern.sub(by, text)
    return text.split()


def chrf_grams(text: str) -> dict[str, Counter]:
    chars, ws = "".join(text.split()), chrf_words(text)
    out = {f"c{n}": Counter([chars[i : i + n] for i in range(len(chars) - n + 1)]) for n in range(1, CHAR_ORDER + 1)}
    return out | {f"w{n}": Counter(zip(*[ws[i:] for i in range(n)], strict=False)) for n in range(1, WORD_ORDER + 1)}


def bleu_grams(text: str) -> dict[str, Counter]:
    ws = bleu_words(text)
    return {f"b{n}": Counter(zip(*[ws[i:] for i in range(n)], strict=False)) for n in range(1, BLEU_ORDER + 1)}


#: For each metric, the n-grams of a sentence by kind.
METRICS: dict[str, Callable[[str], dict[str, Counter]]] = {"chrfpp": chrf_grams, "bleu": bleu_grams}


def match_statistics(rows: DataFrame, ids: list[str], metric: str) -> DataFrame:
    """(ids, kind, hyp, ref, match): n-grams of each side and clipped matches, per sentence and order.

    Both sides are in one row (pred, ref), so nothing is exchanged; a few sums a sentence come out. Null is empty.
    """
    grams = METRICS[metric]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], ([], [], [], [])
            for i, (pred, ref) in enumerate(zip(b.column(len(ids)).to_pylist(), b.column(len(ids) + 1).to_pylist(), strict=True)):
                h, r = grams(pred or ""), grams(ref or "")
                for kind, have in h.items():
                    want = r[kind]
                    at.append(i)
                    for c, v in zip(cols, (kind, have.total(), want.total(), sum(min(n, want[g]) for g, n in have.items() if g in want)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in b.columns[: len(ids)]], pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], [*ids, "kind", "hyp", "ref", "match"])

    return rows.select(*ids, "pred", "ref").mapInArrow(run, f"{kinds}, kind string, hyp long, ref long, match long")


def chrf(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, chrf): precision and recall averaged over the orders that both sides have, then F with beta 2, 0-100."""
    total = stats.groupBy(*by, "kind").agg(*[F.sum(c).alias(c) for c in ("hyp", "ref", "match")]).where("hyp > 0 AND ref > 0")
    p, r, b2 = F.avg(F.col("match") / F.col("hyp")), F.avg(F.col("match") / F.col("ref")), BETA**2
    return total.groupBy(*by).agg(F.coalesce(100 * (1 + b2) * p * r / F.nullif(b2 * p + r, F.lit(0.0)), F.lit(0.0)).alias("chrf"))


def bleu(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, bleu): four orders, brevity penalty, exponential smoothing of orders without a match, 0-100."""
    total = stats.groupBy(*by, "kind").agg(*[F.sum(c).alias(c) for c in ("hyp", "ref", "match")])
    at = lambda k, c: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    wide = total.groupBy(*by).agg(*[at(f"b{n}", "match").alias(f"m{n}") for n in range(1, 5)], *[at(f"b{n}", "hyp").alias(f"h{n}") for n in range(1, 5)], at("b1", "ref").alias("r1"))
    logs, misses = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        m, h = F.col(f"m{n}"), F.col(f"h{n}")
        misses = misses + (m == 0).cast("int")
        logs = logs + F.when(m > 0, F.log(m / h)).otherwise(-F.log(F.pow(F.lit(2.0), misses) * h))
    brevity = F.when(F.col("h1") < F.col("r1"), F.exp(1 - F.col("r1") / F.col("h1"))).otherwise(1.0)
    fits = (F.col("h4") > 0) & (F.col("m1") > 0)
    return wide.select(*by, F.when(fits, 100 * brevity * F.exp(logs / 4)).otherwise(0.0).alias("bleu"))


def scores(stats: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by, score) of a corpus metric from statistics of its sentences."""
    return chrf(stats, by).withColumnRenamed("chrf", "score") if metric == "chrfpp" else bleu(stats, by).withColumnRenamed("bleu", "score")


def paired_bootstrap(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, score_a, score_b, delta, lo, hi, p) from scores (by, b, score_a, score_b); b = -1 is the observed sample."""
    d = F.col("score_a") - F.col("score_b")
    seen = lambda c: F.max(F.when(F.col("b") < 0, c))
    resampled = F.when(F.col("b") >= 0, d)
    out = scores.groupBy(*by).agg(*[seen(F.col(c)).alias(c) for c in ("score_a", "score_b")], seen(d).alias("delta"), F.percentile(resampled, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((resampled <= 0).cast("double")).alias("down"), F.avg((resampled >= 0).cast("double")).alias("up"))
    one = F.when(F.col("delta") > 0, F.col("down")).when(F.col("delta") < 0, F.col("up")).otherwise(0.5)
    return out.select(*by, "score_a", "score_b", "delta", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.least(2 * one, F.lit(1.0)).alias("p"))


def greedy_match(hyp: DataFrame, ref: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, precision, recall, f1) of token vectors: each token's best cosine on the other side, averaged."""
    from glossa.functions import vectors as V

    x = hyp.select(*ids, F.col("pos").alias("i"), V.unit(F.col("vec")).alias("u"))
    y = ref.select(*ids, F.col("pos").alias("j"), V.unit(F.col("vec")).alias("v"))
    sim = x.join(y, ids).select(*ids, "i", "j", V.dot(F.col("u"), F.col("v")).alias("s"))
    p = sim.groupBy(*ids, "i").agg(F.max("s").alias("s")).groupBy(*ids).agg(F.avg("s").alias("precision"))
    r = sim.groupBy(*ids, "j").agg(F.max("s").alias("s")).groupBy(*ids).agg(F.avg("s").alias("recall"))
    return p.join(r, ids).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


TOKEN = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")


def token_scores(rows: DataFrame, ids: list[str], make_encoder: Callable[[], object]) -> DataFrame:
    """(ids, precision, recall, f1) of rows (ids, pred, ref): greedy matches of the letter tokens' vectors, a sentence
    at a time, so that no pair of tokens leaves its row. Null for a side without tokens."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = make_encoder(), {}

        def units(text: str | None) -> np.ndarray:
            ws = TOKEN.findall(text or "")
            new = list({w for w in ws if w not in known})
            if len(known) + len(new) > 100_000:
                known.clear()
                new = list(set(ws))
            for w, v in zip(new, encoder.encode(new), strict=True):
                known[w] = v / (np.linalg.norm(v) or 1)
            return np.array([known[w] for w in ws])

        for b in batches:
            out = []
            for pred, ref in zip(b.column(len(ids)).to_pylist(), b.column(len(ids) + 1).to_pylist(), strict=True):
                x, y = units(pred), units(ref)
                if not len(x) or not len(y):
                    out.append((None, None, None))
                    continue
                sim = x @ y.T
                p, r = float(sim.max(1).mean()), float(sim.max(0).mean())
                out.append((p, r, 2 * p * r / (p + r) if p + r else None))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(ids)], *[pa.array([o[k] for o in out], pa.float64()) for k in range(3)]], [*ids, "precision", "recall", "f1"])

    return rows.select(*ids, "pred", "ref").mapInArrow(run, f"{kinds}, precision double, recall double, f1 double")

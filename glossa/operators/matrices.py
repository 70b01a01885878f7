"""What needs a whole small matrix at once: linkage, cophenetic distances, MDS, Procrustes, principal directions.

The matrices have a row for each group or dimension, never for each document; they are checked for size before
they come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import vectors as V

MAX_ROWS = 2000


def rows_of(df: DataFrame, key: str, value: str, most: int = MAX_ROWS) -> dict:
    """{key: value} of a table with a row for each group; refuses more than `most` rows."""
    rows = df.select(key, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups")
    return {r[0]: r[1] for r in rows}


def square(m: DataFrame) -> tuple[list, np.ndarray]:
    """Codes and matrix of a long table (a, b, d); refuses more than MAX_ROWS codes or more than one row a cell."""
    codes = [r[0] for r in m.select("a").distinct().orderBy("a").limit(MAX_ROWS + 1).collect()]
    if len(codes) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} groups")
    at = {c: i for i, c in enumerate(codes)}
    out = np.zeros((len(codes), len(codes)))
    rows = m.select("a", "b", "d").limit(len(codes) ** 2 + 1).collect()
    if len(rows) > len(codes) ** 2:
        raise ValueError("more than one row for a pair of groups")
    for r in rows:
        out[at[r["a"]], at[r["b"]]] = r["d"]
    return codes, out


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Agglomerative clustering by Lance-Williams updates: rows (left, right, height, size)."""
    n = len(d)
    d = d.astype(float).copy()
    if method == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    ids, sizes, live, out = list(range(n)), [1] * n, list(range(n)), []
    for step in range(n - 1):
        sub = d[np.ix_(live, live)]
        x, y = divmod(int(np.argmin(sub)), len(live))
        i, j = live[min(x, y)], live[max(x, y)]
        h, a, b = d[i, j], sizes[i], sizes[j]
        out.append([min(ids[i], ids[j]), max(ids[i], ids[j]), np.sqrt(h) if method == "ward" else h, a + b])
        k = [q for q in live if q not in (i, j)]
        if method == "single":
            new = np.minimum(d[i, k], d[j, k])
        elif method == "complete":
            new = np.maximum(d[i, k], d[j, k])
        elif method == "ward":
            s = np.array([sizes[q] for q in k])
            new = ((a + s) * d[i, k] + (b + s) * d[j, k] - s * h) / (a + b + s)
        else:
            new = (a * d[i, k] + b * d[j, k]) / (a + b)
        d[i, k] = d[k, i] = new
        live.remove(j)
        ids[i], sizes[i] = n + step, a + b
    return np.array(out)


def members(z: np.ndarray) -> list[list[int]]:
    n = len(z) + 1
    out = [[i] for i in range(n)]
    for a, b, *_ in z:
        out.append(out[int(a)] + out[int(b)])
    return out


def cophenetic(z: np.ndarray) -> np.ndarray:
    """Height at which each two leaves first share a cluster."""
    n, groups = len(z) + 1, members(z)
    out = np.zeros((n, n))
    for a, b, h, _ in z:
        out[np.ix_(groups[int(a)], groups[int(b)])] = h
        out[np.ix_(groups[int(b)], groups[int(a)])] = h
    return out


def cut(z: np.ndarray, k: int) -> list[int]:
    """Flat labels of k clusters: undo the last k - 1 merges."""
    n, groups = len(z) + 1, members(z)
    live = set(range(n))
    for s in range(n - k):
        live -= {int(z[s, 0]), int(z[s, 1])}
        live.add(n + s)
    labels = [0] * n
    for label, g in enumerate(sorted(live, key=lambda g: min(groups[g]))):
        for i in groups[g]:
            labels[i] = label
    return labels


def mds(d: np.ndarray, dims: int = 2, steps: int = 300) -> np.ndarray:
    """Metric scaling by stress majorisation, started from the classical solution; signs fixed by the first row."""
    n = len(d)
    j = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    x = v[:, ::-1][:, :dims] * np.sqrt(np.maximum(w[::-1][:dims], 1e-12))
    for _ in range(steps):
        e = np.linalg.norm(x[:, None] - x[None], axis=2)
        b = np.where(e > 0, -d / np.where(e > 0, e, 1), 0)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(1))
        x = b @ x / n
    return x * np.where(x[0] < 0, -1, 1)


def procrustes(a: np.ndarray, b: np.ndarray) -> float:
    """Disparity of the best rotation of unit rows a onto unit rows b, from the nuclear norm of their product."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    a, b = unit(a), unit(b)
    left = (a**2).sum() + (b**2).sum() - 2 * np.linalg.svd(a.T @ b, compute_uv=False).sum()
    return float(np.sqrt(max(0.0, left) / (b**2).sum()))


def isotropic(rows: DataFrame, dims: int, k: int = 1) -> DataFrame:
    """Rows without their mean and their k first principal directions. Mean and dims x dims moments are aggregates."""
    mean = np.array(rows.agg(V.mean_of("vec", dims).alias("m")).first()[0] or [0.0] * dims)
    if k <= 0:
        return rows.withColumn("vec", F.zip_with("vec", F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, dims)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "x"])

    n = rows.count()
    sums = rows.select("vec").mapInArrow(products, "i int, x array<double>").groupBy("i").agg(V.sum_of("x", dims).alias("x"))
    moments = np.zeros((dims, dims))
    for r in sums.collect():  # dims rows
        moments[r["i"]] = r["x"]
    _, v = np.linalg.eigh(moments - n * np.outer(mean, mean))
    out = F.zip_with("vec", F.array(*map(F.lit, mean.tolist())), lambda x, m: x.cast("double") - m)
    rows = rows.withColumn("vec", out)
    for c in range(1, min(k, dims - 1, max(1, n - 1)) + 1):
        p = F.array(*map(F.lit, v[:, -c].tolist()))
        rows = rows.withColumn("_p", V.dot(F.col("vec"), p)).withColumn("vec", F.zip_with("vec", p, lambda x, q: x - F.col("_p") * q)).drop("_p")
    return rows

"""Comparisons of embedding methods with each other: all pairs of methods in one plan, for each of four measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators import statistics as S


def paired(distances: DataFrame) -> DataFrame:
    """(method_a, method_b, a, b, x, y): what two methods say of the pairs a < b of the groups that both have."""
    d = distances.where("a < b")
    x, y = d.select(F.col("method").alias("method_a"), "a", "b", F.col("d").alias("x")), d.select(F.col("method").alias("method_b"), "a", "b", F.col("d").alias("y"))
    return x.join(y, ["a", "b"]).where("method_a < method_b")


def shared_groups(codes: DataFrame) -> DataFrame:
    """(method_a, method_b, n_varieties) from (method, code)."""
    x, y = codes.select(F.col("method").alias("method_a"), "code"), codes.select(F.col("method").alias("method_b"), "code")
    return x.join(y, "code").where("method_a < method_b").groupBy("method_a", "method_b").agg(F.count(F.lit(1)).alias("n_varieties"))


def codes_of(distances: DataFrame) -> DataFrame:
    return distances.select("method", F.col("a").alias("code")).union(distances.select("method", "b")).distinct()


def require_two(distances: DataFrame) -> None:
    if (n := distances.select("method").distinct().limit(2).count()) < 2:
        raise ValueError(f"at least 2 methods are needed; found {n}")


def rank_correlations(distances: DataFrame) -> DataFrame:
    """(method_a, method_b, rho): rank correlation of distances (method, a, b, d), also of pairs the other way round and
    1 of each method with itself; null below three shared groups."""
    n = shared_groups(codes_of(distances))
    rho = n.join(S.spearman(paired(distances), ["method_a", "method_b"], "x", "y"), ["method_a", "method_b"], "left").select("method_a", "method_b", F.when(F.col("n_varieties") >= 3, F.col("rho")).alias("rho"))
    own = distances.select(F.col("method").alias("method_a"), F.col("method").alias("method_b")).distinct().withColumn("rho", F.lit(1.0))
    return rho.unionByName(rho.select(F.col("method_b").alias("method_a"), F.col("method_a").alias("method_b"), "rho")).unionByName(own)


def mantel_table(distances: DataFrame, permutations: int = 999, seed: str = "42") -> DataFrame:
    """(method_a, method_b, mantel_r, p_value, n_varieties, significant_005): Pearson correlation and the share of
    relabellings of the second method's groups that correlate as well, the seen one among them.

    The groups that two methods share are relabelled among themselves; pairs of methods with fewer than three are left
    out. Relabellings are drawn by hash of pair, replicate and group.
    """
    codes = codes_of(distances)
    n = shared_groups(codes).where("n_varieties >= 3")
    x, y = codes.select(F.col("method").alias("method_a"), "code"), codes.select(F.col("method").alias("method_b"), "code")
    both = x.join(y, "code").join(n, ["method_a", "method_b"]).withColumn("pair", F.concat_ws("/", "method_a", "method_b"))
    perms = relabelled(both, permutations, seed)
    d = paired(distances)
    seen = d.groupBy("method_a", "method_b").agg(F.corr("x", "y").alias("r"))
    to_a, to_b = perms.withColumnsRenamed({"code": "a", "to": "ta"}), perms.withColumnsRenamed({"code": "b", "to": "tb"})
    keys = ["method_a", "method_b"]
    moved = d.select(*keys, "a", "b", "x").join(to_a, [*keys, "a"]).join(to_b, [*keys, "it", "b"])
    moved = moved.select(*keys, "it", "x", F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    r = moved.join(d.select(*keys, "a", "b", "y"), [*keys, "a", "b"]).groupBy(*keys, "it").agg(F.corr("x", "y").alias("moved"))
    p = r.join(seen, keys).groupBy(*keys).agg(((F.count_if(F.col("moved") >= F.col("r") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    out = n.join(seen, keys).join(p, keys, "left").select(*keys, F.col("r").alias("mantel_r"), "p_value", "n_varieties")
    return out.withColumn("significant_005", F.col("p_value") < 0.05)


def relabelled(both: DataFrame, permutations: int, seed: str) -> DataFrame:
    """(method_a, method_b, it, code, to): a random order of the groups that two methods share, for each replicate."""
    keys = ["method_a", "method_b"]
    place = both.select(*keys, F.col("code").alias("to"), F.row_number().over(Window.partitionBy(*keys).orderBy("code")).alias("pos"))
    each = both.select(*keys, "pair", "code", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("it"))
    key = F.md5(F.concat_ws("-", F.lit(seed), "pair", F.col("it").cast("string"), F.col("code").cast("string")).cast("binary"))
    drawn = each.withColumn("pos", F.row_number().over(Window.partitionBy(*keys, "it").orderBy(key, "code")))
    return drawn.join(place, [*keys, "pos"]).select(*keys, "it", "code", "to")


def space_table(vectors: DataFrame) -> DataFrame:
    """(method_a, method_b, n_varieties, procrustes, cka) from vectors (method, code, vec).

    Both measures follow from sums over the shared groups: with C the sum of outer products of unit vectors, the best
    rotation leaves |A|^2 + |B|^2 - 2 |C|*, the last a nuclear norm; CKA compares the centred sums of outer products.
    Each task sends one such sum for a pair of methods, so no table of vectors is ever in one place. Fewer than two
    shared groups give nulls, as do vectors of different lengths for the rotation.
    """
    kind = vectors.schema["method"].dataType.simpleString()
    x, y = vectors.select(F.col("method").alias("method_a"), "code", F.col("vec").alias("x")), vectors.select(F.col("method").alias("method_b"), "code", F.col("vec").alias("y"))
    met = x.join(y, "code").where("method_a < method_b").select("method_a", "method_b", "x", "y")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            groups: dict = {}
            for m, n, v, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                groups.setdefault((m, n), []).append((v, w))
            for key, of in groups.items():
                one = moments(np.array([v for v, _ in of], float), np.array([w for _, w in of], float))
                sums[key] = [p + q for p, q in zip(sums[key], one, strict=True)] if key in sums else one
        for (m, n), of in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([m], b.schema.field(0).type), pa.array([n], b.schema.field(1).type), *[pa.array([np.ravel(p).tolist()], pa.list_(pa.float64())) for p in of]], ["method_a", "method_b", *PARTS])

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        of = [sum(np.array(v) for v in table.column(c).to_pylist()) for c in PARTS]
        n, p, q = int(of[0][0]), len(of[1]), len(of[2])
        procrustes, cka = measures(n, of[1], of[2], of[3].reshape(p, p), of[4].reshape(p, q), of[5].reshape(q, q), of[6].reshape(p, q), of[7])
        return pa.Table.from_arrays([pa.array([k.as_py()], k.type) for k in key] + [pa.array([n], pa.int64()), pa.array([procrustes], pa.float64()), pa.array([cka], pa.float64())], ["method_a", "method_b", "n_varieties", "procrustes", "cka"])

    parts = met.mapInArrow(add, f"method_a {kind}, method_b {kind}, " + ", ".join(f"{c} array<double>" for c in PARTS))
    return parts.groupBy("method_a", "method_b").applyInArrow(finish, f"method_a {kind}, method_b {kind}, n_varieties long, procrustes double, cka double")


PARTS = ["n", "sx", "sy", "xx", "xy", "yy", "uv", "units"]


def moments(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Count, sums, sums of outer products, the one of unit vectors, and squared lengths of those."""
    u, v = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
    return [np.array([float(len(x))]), x.sum(0), y.sum(0), x.T @ x, x.T @ y, y.T @ y, u.T @ v, np.array([(u * u).sum(), (v * v).sum()])]


def measures(n: int, sx, sy, xx, xy, yy, uv, units) -> tuple[float | None, float | None]:
    if n < 2:
        return None, None
    procrustes = None
    if len(sx) == len(sy) and units[1] > 0:
        procrustes = float(np.sqrt(max(0.0, units[0] + units[1] - 2 * np.linalg.svd(uv, compute_uv=False).sum()) / units[1]))
    xx, xy, yy = xx - np.outer(sx, sx) / n, xy - np.outer(sx, sy) / n, yy - np.outer(sy, sy) / n
    below = np.linalg.norm(xx) * np.linalg.norm(yy)
    return procrustes, float((xy * xy).sum() / below) if below > 1e-300 else None


def compare_methods(distances: DataFrame, vectors: DataFrame | None = None, permutations: int = 999, seed: str = "42") -> dict[str, DataFrame]:
    """The tables of a comparison by name: correlations, mantel (unless permutations is 0), and space where there are
    vectors. At least two methods are needed."""
    require_two(distances)
    out = {"correlations": rank_correlations(distances)}
    if permutations > 0:
        out["mantel"] = mantel_table(distances, permutations, seed)
    if vectors is not None:
        out["space"] = space_table(vectors)
    return out


def report(tables: dict[str, DataFrame]) -> list[str]:
    """The lines of a readable summary: a row for each pair of methods, so for as many as there are methods to compare."""
    lines = ["Cross-method comparison", "=" * 60]
    for name, keys in (("correlations", ["method_a", "method_b"]), ("mantel", [F.desc_nulls_last("mantel_r"), "method_a", "method_b"]), ("space", ["method_a", "method_b"])):
        if name in tables:
            df = tables[name].orderBy(*keys)
            lines += ["", name, " | ".join(df.columns)]
            lines += [" | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in df.toLocalIterator()]
    return lines

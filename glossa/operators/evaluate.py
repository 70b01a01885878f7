"""One evaluation of group vectors: every table and score by name, computed when asked for.

Distances are computed once and kept while the result is in use (`Evaluation.close` gives them back). Linkage, cut and
scaling take a matrix with a row for each group to the driver, behind the size check of `matrices`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import vectors as V
from glossa.operators import evaluation as E
from glossa.operators import matrices as M
from glossa.operators import statistics as S
from glossa.operators.relational import nearest


class Evaluation:
    """vectors: (code, vec); families: (code, family), a row for each group, those without one being left out of what
    needs families. romance and dialects name families. golds: (gold, a, b, g) with a < b, or None."""

    def __init__(self, vectors: DataFrame, families: DataFrame, dims: int, romance: set[str] = frozenset(), dialects: set[str] = frozenset(), golds: DataFrame | None = None, role: Callable[[Column], Column] | None = None, normalise: bool = True, isotropy: int = 0, linkage: str = "average", neighbours: int = 3, seed: int = 42):
        if vectors.groupBy("code").count().where("count > 1 OR code IS NULL").limit(1).count():
            raise ValueError("one vector for each group is needed")
        rows = M.isotropic(vectors, dims, isotropy) if isotropy else vectors
        self.vectors = rows.select("code", V.unit(F.col("vec")).alias("vec") if normalise else "vec")
        self.families, self.romance, self.dialects = families, romance, dialects
        self.golds, self.role, self.method, self.k, self.seed = golds, role, linkage, neighbours, seed

    @cached_property
    def distances(self) -> DataFrame:
        return V.cosine_distances(self.vectors, "code").persist()

    def close(self) -> None:
        if "distances" in self.__dict__:
            self.distances.unpersist()

    @cached_property
    def matrix(self) -> tuple[list, np.ndarray]:
        return M.square(self.distances)

    @cached_property
    def tree(self) -> np.ndarray:
        return M.linkage(self.matrix[1], self.method)

    def neighbours(self) -> DataFrame:
        return nearest(self.distances, self.k).select(F.col("a").alias("code"), "rank", F.col("b").alias("neighbour"), "d")

    def profiles(self) -> DataFrame:
        return E.profiles(self.distances, self.families)

    def cohesion(self) -> DataFrame:
        return E.cohesion(self.distances, self.families)

    def silhouettes(self) -> DataFrame:
        return E.silhouettes(self.distances, self.families).select(F.col("a").alias("code"), "family", F.col("s").alias("silhouette"))

    def silhouette(self, families: DataFrame) -> float | None:
        """Mean over the groups of a grouping; none with fewer than two families, or with a family for each group."""
        n, k = families.agg(F.count(F.lit(1)), F.count_distinct("family")).first()
        if not 2 <= k <= n - 1:
            return None
        return E.silhouettes(self.distances, families).agg(F.avg("s")).first()[0]

    def scores(self) -> dict[str, float | None]:
        """Silhouettes by family, of Romance groups against the rest, and of the same without dialects."""
        binary = self.families.select("code", F.col("family").isin(sorted(self.romance)).cast("string").alias("family"), F.col("family").isin(sorted(self.dialects)).alias("dialect"))
        return {"family": self.silhouette(self.families), "romance vs rest": self.silhouette(binary.drop("dialect")), "romance, no dialects": self.silhouette(binary.where("NOT dialect").drop("dialect"))}

    def projection(self) -> DataFrame:
        codes, d = self.matrix
        spark = self.vectors.sparkSession
        rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(M.mds(d))]
        names = spark.createDataFrame(list(enumerate(codes)), f"i int, code {self.vectors.schema['code'].dataType.simpleString()}")
        return names.join(spark.createDataFrame(rows, "i int, x double, y double"), "i").select("code", "x", "y")

    def linkage(self) -> DataFrame:
        rows = [(i, int(a), int(b), float(h), int(n)) for i, (a, b, h, n) in enumerate(self.tree)]
        return self.vectors.sparkSession.createDataFrame(rows, "step int, left int, right int, height double, size int")

    def clusters(self, k: int) -> DataFrame:
        """(code, hierarchical, kmeans): two partitions into as many parts as there are families."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        codes, _ = self.matrix
        spark = self.vectors.sparkSession
        cut = spark.createDataFrame([(c, int(x)) for c, x in zip(codes, M.cut(self.tree, min(k, len(codes))), strict=True)], f"code {self.vectors.schema['code'].dataType.simpleString()}, hierarchical int")
        rows = self.vectors.select("code", array_to_vector("vec").alias("features")).persist()
        best = min((KMeans(k=k, seed=self.seed + s, maxIter=50).fit(rows) for s in range(5)), key=lambda m: m.summary.trainingCost)
        out = best.transform(rows).select("code", F.col("prediction").alias("kmeans")).join(cut, "code")
        return out.select("code", "hierarchical", "kmeans")

    def clustering(self) -> DataFrame:
        """(metric, value, clusterer): agreement of both partitions with the families."""
        k = self.families.agg(F.count_distinct("family")).first()[0]
        found = self.clusters(k).join(self.families, "code")
        out = None
        for by in ("hierarchical", "kmeans"):
            one = E.partition_agreement(found, "family", by).unpivot([], ["ari", "nmi", "v_measure"], "metric", "value").withColumn("clusterer", F.lit(by))
            out = one if out is None else out.unionByName(one)
        return out

    def gold_correlations(self) -> DataFrame | None:
        """(gold, block, rho, n): null correlations where too few pairs are shared."""
        if self.golds is None or self.role is None:
            return None
        pairs = self.distances.where("a < b").join(self.golds, ["a", "b"])
        return S.spearman(S.blocks(pairs, self.role(F.col("a")), self.role(F.col("b"))), ["gold", "block"], "d", "g")

    def tables(self) -> dict[str, DataFrame]:
        """All tables by the name under which a run keeps them."""
        out = {"distances": self.distances, "similarity": self.distances.select("a", "b", (1 - F.col("d")).alias("similarity")), "nearest_neighbors": self.neighbours(), "projection_mds": self.projection(), "linkage": self.linkage(), "per_variety_profiles": self.profiles(), "family_stats": self.cohesion(), "clustering_metrics": self.clustering(), "silhouettes": self.silhouettes()}
        gold = self.gold_correlations()
        return out if gold is None else out | {"gold_correlations": gold}

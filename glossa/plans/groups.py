"""Queries over groups of vectors: distances, evaluation, statistics, consensus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.functions import vectors as V
from glossa.operators import evaluation as E
from glossa.operators import matrices as M
from glossa.operators import relational as R
from glossa.operators import resampling as RS
from glossa.operators import statistics as S
from glossa.plans.base import DIMS, DISTANCES, FAM, H32, METHODS, ROLE, distances, embeddings, family, group_vectors, method_distances, role, rounded, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dim(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").alias("code")).distinct().withColumn("family", family(F.col("code")))


U = "u AS (SELECT vec_id, label AS code, list_transform(embedding::DOUBLE[], lambda x: x / coalesce(nullif(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z))), 0), 1)) AS v FROM embeddings)"
POS = "q AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY code) AS k FROM u), p AS (SELECT code, pos, v FROM q WHERE pos < (SELECT min(k) FROM q))"


def _aligned(spark, sf):
    """Vectors by position in their group, as many positions as the smallest group has."""
    e = embeddings(spark, sf)
    least = e.groupBy("code").count().agg(F.min("count")).first()[0] or 0
    w = Window.partitionBy("code").orderBy("vec_id")
    return e.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).where(F.col("pos") < least)


@query(f"WITH {U} SELECT vec_id, round(v[1], 6) + 0 AS x1, round(v[64], 6) + 0 AS x64, round(sqrt(list_sum(list_transform(v, lambda z: z * z))), 6) AS len FROM u")
def vec1_l2_normalise(spark, sf):
    u = embeddings(spark, sf).select("vec_id", V.unit(F.col("vec")).alias("v"))
    return u.select("vec_id", rounded(F.col("v")[0]).alias("x1"), rounded(F.col("v")[63]).alias("x64"), rounded(V.norm(F.col("v"))).alias("len"))


@query()
def vec2_isotropy(spark, sf):
    out = M.isotropic(embeddings(spark, sf), DIMS, 2)
    return out.select("vec_id", "code", rounded(V.norm(F.col("vec")), 5).alias("len"))


@query(f"WITH {DISTANCES} SELECT a, b, round(d, 6) AS d FROM m")
def vec3_cosine_matrix(spark, sf):
    return distances(spark, sf).select("a", "b", rounded("d").alias("d"))


@query("WITH t AS (SELECT conv_id, unnest(string_split(text, ' ')) AS w FROM conversations) SELECT conv_id, round(avg(length(w)), 6) AS x1, round(avg(ascii(w)), 6) AS x2 FROM t WHERE w <> '' GROUP BY conv_id")
def vec4_mean_pool(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    model = t.select("conv_id", F.array(F.length("w").cast("double"), F.ascii("w").cast("double")).alias("vec"))
    pooled = model.groupBy("conv_id").agg(V.mean_of("vec", 2).alias("vec"))
    return pooled.select("conv_id", F.round(F.col("vec")[0], 6).alias("x1"), F.round(F.col("vec")[1], 6).alias("x2"))


@query(f"WITH {DISTANCES} SELECT code, i::INTEGER AS i, round(x, 6) + 0 AS x FROM e")
def vec5_centroids(spark, sf):
    return group_vectors(spark, sf).select("code", F.posexplode("vec").alias("i", "x")).select("code", (F.col("i") + 1).alias("i"), rounded("x").alias("x"))


@query(f"WITH {U}, {POS} SELECT code, pos, round(v[1], 6) + 0 AS x1 FROM p")
def vec7_aligned_vectors(spark, sf):
    return _aligned(spark, sf).select("code", "pos", rounded(V.unit(F.col("vec"))[0]).alias("x1"))


NEAREST = "nn AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM m WHERE a <> b)"


@query(f"WITH {DISTANCES}, {NEAREST} SELECT a AS code, max(CASE WHEN rank = 1 THEN b END) AS nn_1, round(max(CASE WHEN rank = 1 THEN d END), 6) AS dist_1, max(CASE WHEN rank = 2 THEN b END) AS nn_2, round(max(CASE WHEN rank = 2 THEN d END), 6) AS dist_2, max(CASE WHEN rank = 3 THEN b END) AS nn_3, round(max(CASE WHEN rank = 3 THEN d END), 6) AS dist_3 FROM nn WHERE rank <= 3 GROUP BY a")
def ev1_nearest_neighbours(spark, sf):
    top = R.nearest(distances(spark, sf), 3)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return top.groupBy(F.col("a").alias("code")).agg(*[x for k in (1, 2, 3) for x in (at(k, "b").alias(f"nn_{k}"), rounded(at(k, "d")).alias(f"dist_{k}"))])


@query(f"WITH {DISTANCES} SELECT a AS source, b AS target, round(d, 6) AS distance, round(1 - d, 6) AS similarity, {FAM.format('b')} AS target_family FROM m WHERE a <> b")
def ev2_profiles(spark, sf):
    return E.profiles(distances(spark, sf), _dim(spark, sf)).select("source", "target", rounded("distance").alias("distance"), rounded("similarity").alias("similarity"), "target_family")


@query(f"""WITH {DISTANCES}, x AS (SELECT *, {FAM.format('a')} AS fa, {FAM.format('b')} AS fb FROM m)
SELECT fa AS family, count(DISTINCT a)::BIGINT AS n_members, round(avg(d) FILTER (fa = fb AND a < b), 6) AS mean_intra, round(stddev_pop(d) FILTER (fa = fb AND a < b), 6) AS std_intra, round(avg(d) FILTER (fa <> fb), 6) AS mean_inter, round(stddev_pop(d) FILTER (fa <> fb), 6) AS std_inter,
round(CASE WHEN avg(d) FILTER (fa = fb AND a < b) > 0 THEN avg(d) FILTER (fa <> fb) / avg(d) FILTER (fa = fb AND a < b) END, 6) AS cohesion_ratio FROM x GROUP BY fa""")
def ev3_family_cohesion(spark, sf):
    c = E.cohesion(distances(spark, sf), _dim(spark, sf))
    return c.select("family", "n_members", *[rounded(x).alias(x) for x in ("mean_intra", "std_intra", "mean_inter", "std_inter", "cohesion_ratio")])


SIL = """g AS (SELECT a, {fa} AS fa, {fb} AS fb, avg(d) AS d FROM m WHERE a <> b {where} GROUP BY ALL),
k AS (SELECT a, fa AS family, max(d) FILTER (fa = fb) AS own, min(d) FILTER (fa <> fb) AS other FROM g GROUP BY ALL), s AS (SELECT a, family, coalesce((other - own) / nullif(greatest(own, other), 0), 0) AS s FROM k)"""


@query(f"WITH {DISTANCES}, {SIL.format(fa=FAM.format('a'), fb=FAM.format('b'), where='')} SELECT a AS code, family, round(s, 6) + 0 AS s FROM s")
def ev4_silhouette(spark, sf):
    return E.silhouettes(distances(spark, sf), _dim(spark, sf)).select(F.col("a").alias("code"), "family", rounded("s").alias("s"))


@query(f"WITH {DISTANCES}, {SIL.format(fa='(a % 2)', fb='(b % 2)', where='AND a > 1 AND b > 1')} SELECT round(avg(s), 6) + 0 AS silhouette, count(*)::BIGINT AS n FROM s")
def ev5_binary_silhouette(spark, sf):
    d = _dim(spark, sf).where("code > 1").select("code", (F.col("code") % 2).alias("family"))
    s = E.silhouettes(distances(spark, sf).where("a > 1 AND b > 1"), d)
    return s.agg(rounded(F.avg("s")).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {U}, x AS (SELECT vec_id, code, i, v[i] AS x FROM u, (SELECT unnest(range(1, 65)) AS i)), c AS (SELECT code, i, avg(x) AS c, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT i, avg(x) AS g FROM x GROUP BY i),
w AS (SELECT x.code, vec_id, sum((x - c) * (x - c)) AS w FROM x JOIN c USING (code, i) GROUP BY ALL), s AS (SELECT code, avg(sqrt(w)) AS s, sum(w) AS w FROM w GROUP BY code),
pc AS (SELECT p.code AS i, q.code AS j, sqrt(sum((p.c - q.c) * (p.c - q.c))) AS gap FROM c p JOIN c q ON p.i = q.i AND p.code <> q.code GROUP BY ALL),
r AS (SELECT pc.i, max((a.s + b.s) / gap) AS r FROM pc JOIN s a ON a.code = pc.i JOIN s b ON b.code = pc.j GROUP BY pc.i),
bt AS (SELECT sum(n * (c - g) * (c - g)) AS b FROM c JOIN g USING (i))
SELECT round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round((SELECT b FROM bt) / (k - 1) / (w / (n - k)), 6) AS calinski_harabasz FROM (SELECT count(*) AS k, sum(w) AS w FROM s), (SELECT count(*) AS n FROM u)""")
def ev6_dispersion_indexes(spark, sf):
    return E.dispersion(embeddings(spark, sf), "code", DIMS).select(rounded("davies_bouldin").alias("davies_bouldin"), rounded("calinski_harabasz").alias("calinski_harabasz"))


@query()
def ev7_linkage(spark, sf):
    rows = []
    _, d = M.square(distances(spark, sf))
    for method in ("average", "complete", "single", "ward"):
        rows += [(method, i, int(a), int(b), float(round(h, 6)), int(n)) for i, (a, b, h, n) in enumerate(M.linkage(d, method))]
    return spark.createDataFrame(rows, "method string, step int, left int, right int, height double, size int")


@query()
def ev8_cophenetic_cut(spark, sf):
    codes, d = M.square(distances(spark, sf))
    z = M.linkage(d)
    up = np.triu_indices(len(d), 1)
    r = float(np.corrcoef(M.cophenetic(z)[up], d[up])[0, 1])
    labels = M.cut(z, min(4, len(codes)))
    return spark.createDataFrame([(int(c), int(x), round(r, 6)) for c, x in zip(codes, labels, strict=True)], "code int, cluster int, cophenetic_correlation double")


@query()
def ev9_kmeans(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    u = group_vectors(spark, sf).select("code", array_to_vector(V.unit(F.col("vec"))).alias("features")).cache()
    best = min((KMeans(k=4, seed=42 + s, maxIter=20).fit(u) for s in range(5)), key=lambda m: m.summary.trainingCost)
    return best.transform(u).select("code", F.col("prediction").alias("cluster"))


@query("""WITH x AS (SELECT doc_id % 5 AS l1, length(text) % 3 AS l2 FROM documents), c AS (SELECT l1, l2, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT sum(n) AS n FROM c GROUP BY l1), b AS (SELECT sum(n) AS n FROM c GROUP BY l2),
t AS (SELECT sum(n)::DOUBLE AS t, sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS e FROM c), ta AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS e FROM a), tb AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS e FROM b),
h AS (SELECT t.p, ta.p AS pa, tb.p AS pb, t, ln(t) - ta.e / t AS ha, ln(t) - tb.e / t AS hb, ln(t) - t.e / t AS hab FROM t, ta, tb)
SELECT round((p - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) + 0 AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) + 0 AS nmi, round(2 * ((ha + hb - hab) / ha) * ((ha + hb - hab) / hb) / ((ha + hb - hab) / ha + (ha + hb - hab) / hb), 6) + 0 AS v_measure FROM h""")
def ev9b_partition_agreement(spark, sf):
    x = table(spark, sf, "documents").select((F.col("doc_id") % 5).alias("l1"), (F.length("text") % 3).alias("l2"))
    return E.partition_agreement(x, "l1", "l2").select(*[rounded(c).alias(c) for c in ("ari", "nmi", "v_measure")])


@query()
def ev10_full_evaluation(spark, sf):
    """What one evaluation run reports, as (metric, value)."""
    m, dim = distances(spark, sf).cache(), _dim(spark, sf)
    s = E.silhouettes(m, dim).agg(F.avg("s").alias("v")).select(F.lit("silhouette_family").alias("metric"), "v")
    n = m.where("a < b").agg(F.avg("d").alias("v")).select(F.lit("mean_distance").alias("metric"), "v")
    c = E.cohesion(m, dim).agg(F.avg("cohesion_ratio").alias("v")).select(F.lit("mean_cohesion").alias("metric"), "v")
    return s.unionByName(n).unionByName(c).select("metric", rounded("v").alias("value"))


@query()
def ev11_mds(spark, sf):
    codes, d = M.square(distances(spark, sf))
    x = M.mds(d)
    return spark.createDataFrame([(int(c), float(round(p[0], 5)), float(round(p[1], 5))) for c, p in zip(codes, x, strict=True)], "code int, x double, y double")


@query(f"""WITH {U}, d AS (SELECT x.code AS a, y.code AS b, x.vec_id AS i, y.vec_id AS j, 1 - list_dot_product(x.v, y.v) AS d FROM u x, u y)
SELECT a AS code, (SELECT count(*) FROM u WHERE code = a)::BIGINT AS n, round(avg(d) FILTER (a = b AND i <> j), 6) AS within, round(avg(d) FILTER (a <> b), 6) AS between, round(avg(d) FILTER (a <> b) / avg(d) FILTER (a = b AND i <> j), 6) AS separation FROM d GROUP BY a""")
def ev12_within_between(spark, sf):
    return E.within_between(embeddings(spark, sf), "code", DIMS).select("code", "n", *[rounded(c).alias(c) for c in ("within", "between", "separation")])


@query(f"""WITH {U}, d AS (SELECT x.vec_id, x.code, y.code AS other, avg(1 - list_dot_product(x.v, y.v)) AS d FROM u x JOIN u y ON x.vec_id <> y.vec_id GROUP BY ALL),
k AS (SELECT vec_id, code, max(d) FILTER (code = other) AS a, min(d) FILTER (code <> other) AS b FROM d GROUP BY ALL) SELECT vec_id, code, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) + 0 AS s FROM k""")
def ev13_sentence_silhouette(spark, sf):
    return E.sentence_silhouette(embeddings(spark, sf), "code", "vec_id", DIMS).select("vec_id", "code", rounded("s").alias("s"))


ALIGN = f"{U}, {POS}, al AS (SELECT x.code AS a, y.code AS b, avg(list_dot_product(x.v, y.v)) AS sim FROM p x JOIN p y ON x.pos = y.pos AND x.code < y.code GROUP BY ALL)"


@query(f"WITH {ALIGN} SELECT a, b, round(sim, 6) + 0 AS similarity FROM al")
def ev14_parallel_alignment(spark, sf):
    return E.alignment(_aligned(spark, sf), "code", "pos").select("a", "b", rounded("similarity").alias("similarity"))


@query(f"WITH {ALIGN}, s AS (SELECT a AS code, sim FROM al UNION ALL SELECT b, sim FROM al) SELECT code, round(avg(sim), 6) + 0 AS mean, round(max(sim), 6) + 0 AS most, round(min(sim), 6) + 0 AS least, round(stddev_pop(sim), 6) AS std FROM s GROUP BY code")
def ev15_alignment_summary(spark, sf):
    al = E.alignment(_aligned(spark, sf), "code", "pos")
    s = al.select(F.col("a").alias("code"), "similarity").unionByName(al.select(F.col("b").alias("code"), "similarity"))
    x = F.col("similarity")
    return s.groupBy("code").agg(rounded(F.avg(x)).alias("mean"), rounded(F.max(x)).alias("most"), rounded(F.min(x)).alias("least"), rounded(F.stddev_pop(x)).alias("std"))


@query(f"WITH {DISTANCES} SELECT a AS code, round(max(CASE WHEN b = 0 THEN d END), 6) AS c0, round(max(CASE WHEN b = 1 THEN d END), 6) AS c1, round(max(CASE WHEN b = 2 THEN d END), 6) AS c2 FROM m GROUP BY a")
def snk2_matrix_pivot(spark, sf):
    wide = distances(spark, sf).groupBy(F.col("a").alias("code")).pivot("b", [0, 1, 2]).agg(rounded(F.first("d")))
    return wide.withColumnsRenamed({"0": "c0", "1": "c1", "2": "c2"})


PAIRS = "pr AS (SELECT x.method, x.a, x.b, x.d, g.d AS gold FROM mm x JOIN m g ON x.a = g.a AND x.b = g.b WHERE x.a < x.b)"
BLOCK = f"bl AS (SELECT *, 'full' AS block FROM pr UNION ALL SELECT *, 'dialect_external' FROM pr WHERE ({ROLE.format('a')} = 'dialect' AND {ROLE.format('b')} = 'external') OR ({ROLE.format('b')} = 'dialect' AND {ROLE.format('a')} = 'external'))"
BOTH = METHODS + ", " + DISTANCES.split(",\n", 1)[1]
RANKS = "rk AS (SELECT method, block, a, b, rank() OVER (PARTITION BY method, block ORDER BY d) + (count(*) OVER (PARTITION BY method, block, d) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY method, block ORDER BY gold) + (count(*) OVER (PARTITION BY method, block, gold) - 1) / 2.0 AS ry FROM bl)"


def _gold_pairs(spark, sf):
    gold = distances(spark, sf).withColumnRenamed("d", "gold")
    pairs = method_distances(spark, sf).join(gold, ["a", "b"]).where("a < b")
    return S.blocks(pairs, role(F.col("a")), role(F.col("b")))


@query(f"WITH {BOTH}, {PAIRS}, {BLOCK}, {RANKS} SELECT method, block, round(corr(rx, ry), 6) AS rho, count(*)::BIGINT AS n FROM rk GROUP BY ALL")
def st1_4_gold_correlations(spark, sf):
    return S.spearman(_gold_pairs(spark, sf), ["method", "block"], "d", "gold").select("method", "block", rounded("rho").alias("rho"), "n")


@query(f"WITH {METHODS}, j AS (SELECT x.method AS method_a, y.method AS method_b, x.d AS dx, y.d AS dy FROM mm x JOIN mm y ON x.a = y.a AND x.b = y.b AND x.method < y.method WHERE x.a < x.b), r AS (SELECT method_a, method_b, rank() OVER (PARTITION BY method_a, method_b ORDER BY dx) AS rx, rank() OVER (PARTITION BY method_a, method_b ORDER BY dy) AS ry FROM j) SELECT method_a, method_b, round(corr(rx, ry), 6) AS rho FROM r GROUP BY ALL")
def st10_method_correlations(spark, sf):
    m = method_distances(spark, sf).where("a < b")
    x, y = m.withColumnsRenamed({"method": "method_a", "d": "dx"}), m.withColumnsRenamed({"method": "method_b", "d": "dy"})
    return S.spearman(x.join(y, ["a", "b"]).where("method_a < method_b"), ["method_a", "method_b"], "dx", "dy").select("method_a", "method_b", rounded("rho").alias("rho"))


BOOT = 1000


@query(f"""WITH n AS (SELECT label AS code, count(*) AS n FROM embeddings GROUP BY label), r AS (SELECT label AS code, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings),
k AS (SELECT code, n, unnest(range(n)) AS k FROM n), t AS (SELECT *, unnest(range({BOOT})) AS it FROM k),
w AS (SELECT code, it, {H32.format("'42-' || it || '-' || code || '-' || k")} % n AS idx, count(*) AS mult FROM t GROUP BY ALL),
e AS (SELECT it, w.code, i, sum(mult * embedding[i]::DOUBLE) / sum(mult) AS x FROM w JOIN r ON r.code = w.code AND r.idx = w.idx, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
c AS (SELECT it, code, list(x ORDER BY i) AS vec FROM e GROUP BY ALL), g0 AS (SELECT label AS code, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 33)) AS i) GROUP BY ALL), gc AS (SELECT code, list(x ORDER BY i) AS vec FROM g0 GROUP BY code),
pr AS (SELECT p.it, p.code AS a, q.code AS b, greatest(0.0, 1 - list_cosine_similarity(p.vec, q.vec)) AS d, greatest(0.0, 1 - list_cosine_similarity(x.vec, y.vec)) AS gold FROM c p JOIN c q ON p.it = q.it AND p.code < q.code JOIN gc x ON x.code = p.code JOIN gc y ON y.code = q.code),
rk AS (SELECT it, rank() OVER (PARTITION BY it ORDER BY d) AS rx, rank() OVER (PARTITION BY it ORDER BY gold) AS ry FROM pr), rho AS (SELECT it, corr(rx, ry) AS rho FROM rk GROUP BY it)
SELECT round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.025), 6) AS lo, round(quantile_cont(rho, 0.975), 6) AS hi, count(*)::BIGINT AS n_boot FROM rho""")
def st5_bootstrap_ci(spark, sf):
    e = embeddings(spark, sf)
    m = RS.dense_replicates(RS.numbered(e, "code", ["vec_id"]), "code", BOOT, "42")
    half = e.select("code", F.slice("vec", 1, DIMS // 2).alias("vec"))
    gold = V.cosine_distances(V.centroids(half, ["code"], "vec", DIMS // 2), "code").withColumnRenamed("d", "gold")
    rho = S.spearman(m.join(gold, ["a", "b"]), ["it"], "d", "gold")
    return S.bootstrap_summary(rho, [], "rho").select(*[rounded(x).alias(x) for x in ("mean", "lo", "hi")], "n_boot")


#: Relabellings of the rank test and of the other one.
PERMS, PERMS_PEARSON = 10_000, 999


@query(f"""WITH {BOTH}, pr AS (SELECT x.method, x.a, x.b, x.d, g.d AS gold FROM mm x JOIN m g ON x.a = g.a AND x.b = g.b WHERE x.a < x.b),
rk AS (SELECT method, a, b, rank() OVER (PARTITION BY method ORDER BY d) AS rx, rank() OVER (PARTITION BY method ORDER BY gold) AS ry FROM pr),
cs AS (SELECT DISTINCT label AS code FROM embeddings), o AS (SELECT code AS to_code, row_number() OVER (ORDER BY code) AS pos FROM cs), bb AS (SELECT code, unnest(range({PERMS})) AS it FROM cs),
pm AS (SELECT it, code, to_code FROM (SELECT it, code, row_number() OVER (PARTITION BY it ORDER BY md5('11-' || it || '-' || code), code) AS pos FROM bb) JOIN o USING (pos)),
mv AS (SELECT method, pa.it, ry, least(pa.to_code, pb.to_code) AS a, greatest(pa.to_code, pb.to_code) AS b FROM rk JOIN pm pa ON pa.code = rk.a JOIN pm pb ON pb.code = rk.b AND pb.it = pa.it),
r AS (SELECT mv.method, it, corr(rx, mv.ry) AS r FROM mv JOIN rk USING (method, a, b) GROUP BY ALL), s AS (SELECT method, corr(rx, ry) AS rho FROM rk GROUP BY method)
SELECT method, round(max(rho), 6) AS rho, round((count_if(abs(r) >= abs(rho) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM r JOIN s USING (method) GROUP BY method""")
def st8_mantel(spark, sf):
    gold = distances(spark, sf).withColumnRenamed("d", "gold")
    pairs = method_distances(spark, sf).join(gold, ["a", "b"]).where("a < b")
    codes = table(spark, sf, "embeddings").select(F.col("label").alias("code")).distinct()
    out = S.mantel(pairs, R.permuted(codes, "code", PERMS, "11"), ["method"], "d", "gold")
    return out.select("method", rounded("rho").alias("rho"), rounded("p").alias("p"))


@query(f"""WITH {METHODS}, j AS (SELECT x.a, x.b, x.d AS dx, y.d AS dy FROM mm x JOIN mm y ON x.a = y.a AND x.b = y.b AND x.method = 'm0' AND y.method = 'm1'),
cs AS (SELECT DISTINCT label AS code FROM embeddings), o AS (SELECT code AS to_code, row_number() OVER (ORDER BY code) AS pos FROM cs), bb AS (SELECT code, unnest(range({PERMS_PEARSON})) AS it FROM cs),
pm AS (SELECT it, code, to_code FROM (SELECT it, code, row_number() OVER (PARTITION BY it ORDER BY md5('13-' || it || '-' || code), code) AS pos FROM bb) JOIN o USING (pos)),
r AS (SELECT pa.it, corr(k.dx, j.dy) AS r FROM j JOIN pm pa ON pa.code = j.a JOIN pm pb ON pb.code = j.b AND pb.it = pa.it JOIN j k ON k.a = pa.to_code AND k.b = pb.to_code WHERE j.a < j.b GROUP BY ALL)
SELECT round((SELECT corr(dx, dy) FROM j WHERE a < b), 6) AS r, round((count_if(r.r >= (SELECT corr(dx, dy) FROM j WHERE a < b) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM r""")
def st9_mantel_pearson(spark, sf):
    m = method_distances(spark, sf)
    j = m.where("method = 'm0'").select("a", "b", F.col("d").alias("dx")).join(m.where("method = 'm1'").select("a", "b", F.col("d").alias("dy")), ["a", "b"])
    codes = table(spark, sf, "embeddings").select(F.col("label").alias("code")).distinct()
    p = R.permuted(codes, "code", PERMS_PEARSON, "13").select(F.col("b").alias("it"), "code", "to")
    pa, pb = p.withColumnsRenamed({"code": "a", "to": "ta"}), p.withColumnsRenamed({"code": "b", "to": "tb"})
    moved = j.where("a < b").select("a", "b", "dy").join(pa, "a").join(pb, ["it", "b"]).select("it", "dy", F.col("ta").alias("a"), F.col("tb").alias("b"))
    r = moved.join(j.select("a", "b", "dx"), ["a", "b"]).groupBy("it").agg(F.corr("dx", "dy").alias("r"))
    seen = j.where("a < b").agg(F.corr("dx", "dy").alias("seen"))
    return r.join(F.broadcast(seen)).agg(rounded(F.max("seen")).alias("r"), rounded((F.count_if(F.col("r") >= F.col("seen") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


@query()
def st11_procrustes(spark, sf):
    c = M.rows_of(group_vectors(spark, sf), "code", "vec")
    x = np.array([c[k] for k in sorted(c)])
    return spark.createDataFrame([(round(M.procrustes(x[:, :32], x[:, 32:]), 6),)], "disparity double")


@query("""WITH e AS (SELECT label AS code, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
g AS (SELECT p.code AS i, q.code AS j, sum(p.x * q.x) FILTER (p.i <= 32) AS k, sum(p.x * q.x) FILTER (p.i > 32) AS l FROM e p JOIN e q ON p.i = q.i GROUP BY ALL),
c AS (SELECT k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k, l - avg(l) OVER (PARTITION BY i) - avg(l) OVER (PARTITION BY j) + avg(l) OVER () AS l FROM g)
SELECT round(sum(k * l) / sqrt(sum(k * k) * sum(l * l)), 6) AS cka FROM c""")
def st12_linear_cka(spark, sf):
    c = group_vectors(spark, sf)
    half = lambda v, k: F.slice(v, k * 32 + 1, 32)
    x, y = c.select(F.col("code").alias("i"), F.col("vec").alias("x")), c.select(F.col("code").alias("j"), F.col("vec").alias("y"))
    grams = x.join(y, F.lit(True)).select("i", "j", V.dot(half("x", 0), half("y", 0)).alias("k"), V.dot(half("x", 1), half("y", 1)).alias("l"))  # groups x groups
    return S.linear_cka(grams).select(rounded("cka").alias("cka"))


@query(f"WITH {BOTH}, {PAIRS}, {BLOCK}, {RANKS}, r AS (SELECT method, block, corr(rx, ry) AS rho FROM rk GROUP BY ALL) SELECT method, round(max(CASE WHEN block = 'full' THEN rho END), 6) AS full_rho, round(max(CASE WHEN block = 'dialect_external' THEN rho END), 6) AS block_rho, len(method)::INTEGER AS n FROM r GROUP BY method")
def st14_piv1_wide_table(spark, sf):
    r = S.spearman(_gold_pairs(spark, sf), ["method", "block"], "d", "gold")
    wide = r.groupBy("method").pivot("block", ["full", "dialect_external"]).agg(F.first("rho"))
    extra = r.select("method").distinct().select("method", F.length("method").alias("n"))
    return wide.join(extra, "method", "left").select("method", rounded("full").alias("full_rho"), rounded("dialect_external").alias("block_rho"), "n")


@query("SELECT l_returnflag, l_linestatus, round(least(p * count(*) OVER (PARTITION BY l_returnflag), 1), 6) AS p_bonferroni FROM (SELECT l_returnflag, l_linestatus, count(*) / 1000000.0 AS p FROM lineitem GROUP BY ALL)")
def st19_bonferroni(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((F.count(F.lit(1)) / 1000000.0).alias("p"))
    return p.select("l_returnflag", "l_linestatus", F.round(S.bonferroni("p", ["l_returnflag"]), 6).alias("p_bonferroni"))


EXT = f"ext AS (SELECT method, a AS dialect, b AS standard, d FROM mm WHERE {ROLE.format('a')} = 'dialect' AND {ROLE.format('b')} = 'external')"


def _external(spark, sf):
    m = method_distances(spark, sf)
    return m.where((role(F.col("a")) == "dialect") & (role(F.col("b")) == "external")).select("method", F.col("a").alias("dialect"), F.col("b").alias("standard"), "d")


@query(f"WITH {METHODS}, {EXT}, r AS (SELECT method, dialect, rank() OVER (PARTITION BY method ORDER BY avg(d)) AS rk FROM ext GROUP BY method, dialect) SELECT method, max(CASE WHEN dialect = 0 THEN rk END)::INTEGER AS r0, max(CASE WHEN dialect = 1 THEN rk END)::INTEGER AS r1, max(CASE WHEN dialect = 0 THEN rk END) <= 2 AND max(CASE WHEN dialect = 1 THEN rk END) <= 2 AS central FROM r GROUP BY method")
def cq1_mean_distance_ranks(spark, sf):
    mean = _external(spark, sf).groupBy("method", "dialect").agg(F.avg("d").alias("d"))
    r = mean.withColumn("rk", F.rank().over(Window.partitionBy("method").orderBy("d")))
    at = lambda k: F.max(F.when(F.col("dialect") == k, F.col("rk")))
    return r.groupBy("method").agg(at(0).alias("r0"), at(1).alias("r1"), ((at(0) <= 2) & (at(1) <= 2)).alias("central"))


@query(f"WITH {METHODS}, {EXT}, t AS (SELECT *, row_number() OVER (PARTITION BY method, dialect ORDER BY d, standard) AS rk FROM ext) SELECT method, dialect, bool_and(standard IN (5, 6, 7)) AS all_in, max(CASE WHEN rk = 1 THEN standard END) AS top1 FROM t WHERE rk <= 3 GROUP BY ALL")
def cq2_top3_in_set(spark, sf):
    t = _external(spark, sf).withColumn("rk", F.row_number().over(Window.partitionBy("method", "dialect").orderBy("d", "standard"))).where("rk <= 3")
    return t.groupBy("method", "dialect").agg(F.every(F.col("standard").isin(5, 6, 7)).alias("all_in"), F.max(F.when(F.col("rk") == 1, F.col("standard"))).alias("top1"))


@query(f"WITH {METHODS}, {EXT} SELECT method, standard, arg_min(dialect, (d, dialect)) AS nearest FROM ext GROUP BY ALL")
def cq3_nearest_dialect(spark, sf):
    return _external(spark, sf).groupBy("method", "standard").agg(F.min_by("dialect", F.struct("d", "dialect")).alias("nearest"))


GOLDPAIRS = "gp AS (SELECT d AS dialect, 5 + (d * 3 + k) % 5 AS standard FROM (SELECT unnest(range(4)) AS d), (SELECT unnest(range(3)) AS k))"
RECOV = f"""{METHODS}, {EXT}, t AS (SELECT *, row_number() OVER (PARTITION BY method, dialect ORDER BY d, standard) AS r1, row_number() OVER (PARTITION BY method, standard ORDER BY d, dialect) AS r2 FROM ext), {GOLDPAIRS}"""


def _contacts(spark, sf):
    w1, w2 = Window.partitionBy("method", "dialect").orderBy("d", "standard"), Window.partitionBy("method", "standard").orderBy("d", "dialect")
    t = _external(spark, sf).withColumn("r1", F.row_number().over(w1)).withColumn("r2", F.row_number().over(w2))
    gold = spark.createDataFrame([(d, 5 + (d * 3 + k) % 5) for d in range(4) for k in range(3)], "dialect int, standard int")
    return t.join(F.broadcast(gold), ["dialect", "standard"])


@query(f"WITH {RECOV} SELECT dialect, standard, count_if(r1 <= 3)::BIGINT AS dir1, count_if(r2 <= 3)::BIGINT AS dir2, count_if(r1 <= 3) >= 3 OR count_if(r2 <= 3) >= 3 AS recovered FROM t JOIN gp USING (dialect, standard) GROUP BY ALL")
def cq4_bidirectional_recovery(spark, sf):
    one, two = F.count_if(F.col("r1") <= 3), F.count_if(F.col("r2") <= 3)
    return _contacts(spark, sf).groupBy("dialect", "standard").agg(one.alias("dir1"), two.alias("dir2"), ((one >= 3) | (two >= 3)).alias("recovered"))


@query(f"WITH {RECOV} SELECT method, count_if(r1 <= 3 OR r2 <= 3)::BIGINT AS recovered, count_if(r1 <= 3 AND r2 > 3)::BIGINT AS dir1_only, count_if(r1 > 3 AND r2 <= 3)::BIGINT AS dir2_only, count_if(r1 <= 3 AND r2 <= 3)::BIGINT AS both FROM t JOIN gp USING (dialect, standard) GROUP BY method")
def cq5_recovery_tally(spark, sf):
    a, b = F.col("r1") <= 3, F.col("r2") <= 3
    return _contacts(spark, sf).groupBy("method").agg(F.count_if(a | b).alias("recovered"), F.count_if(a & ~b).alias("dir1_only"), F.count_if(~a & b).alias("dir2_only"), F.count_if(a & b).alias("both"))


@query(f"WITH {METHODS}, {EXT}, t AS (SELECT method, dialect, arg_min(standard, (d, standard)) AS top1 FROM ext GROUP BY ALL), v AS (SELECT dialect, top1, count(*) AS votes, min(method) AS first FROM t GROUP BY ALL) SELECT dialect, top1, votes::BIGINT AS votes, row_number() OVER (PARTITION BY dialect ORDER BY votes DESC, first)::INTEGER AS place FROM v")
def cq6_agg7_votes(spark, sf):
    t = _external(spark, sf).groupBy("method", "dialect").agg(F.min_by("standard", F.struct("d", "standard")).alias("top1"))
    v = t.groupBy("dialect", "top1").agg(F.count(F.lit(1)).alias("votes"), F.min("method").alias("first"))
    return v.select("dialect", "top1", "votes", F.row_number().over(Window.partitionBy("dialect").orderBy(F.desc("votes"), "first")).alias("place"))


@query(f"WITH {METHODS}, {EXT}, r AS (SELECT method, dialect, rank() OVER (PARTITION BY method ORDER BY avg(d)) AS rk FROM ext GROUP BY method, dialect) SELECT dialect, round(avg(rk), 6) AS mean_rank, string_agg(rk::VARCHAR, ',' ORDER BY method) AS ranks FROM r GROUP BY dialect")
def cq6_agg9_integration_rank(spark, sf):
    mean = _external(spark, sf).groupBy("method", "dialect").agg(F.avg("d").alias("d"))
    r = mean.withColumn("rk", F.rank().over(Window.partitionBy("method").orderBy("d")))
    ranks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "rk"))), lambda s: s["rk"].cast("string")), ",")
    return r.groupBy("dialect").agg(F.round(F.avg("rk"), 6).alias("mean_rank"), ranks.alias("ranks"))


@query(f"WITH {METHODS}, {EXT}, t AS (SELECT *, row_number() OVER (PARTITION BY method, dialect ORDER BY d, standard) AS pos FROM ext) SELECT dialect, standard, string_agg(pos::VARCHAR, ',' ORDER BY method) AS positions, count_if(pos <= 3)::BIGINT AS in_top3 FROM t GROUP BY ALL")
def cq6_rnk2_positions(spark, sf):
    t = _external(spark, sf).withColumn("pos", F.row_number().over(Window.partitionBy("method", "dialect").orderBy("d", "standard")))
    at = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "pos"))), lambda s: s["pos"].cast("string")), ",")
    return t.groupBy("dialect", "standard").agg(at.alias("positions"), F.count_if(F.col("pos") <= 3).alias("in_top3"))

"""Queries of operators that the other modules use only inside larger ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.operators import relational as R
from glossa.plans.base import DISTANCES, METHODS, ROLE, distances, method_distances, role, rounded, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {DISTANCES} SELECT a, b, round(d, 6) AS d FROM m WHERE a < b")
def jn7_unordered_pairs(spark, sf):
    return distances(spark, sf).where("a < b").select("a", "b", rounded("d").alias("d"))


@query(f"WITH {DISTANCES} SELECT a AS dialect, b AS reference, round(1 - d, 6) AS similarity FROM m WHERE {ROLE.format('a')} = 'dialect' AND {ROLE.format('b')} = 'external'")
def jn8_block_product(spark, sf):
    m = distances(spark, sf).where((role(F.col("a")) == "dialect") & (role(F.col("b")) == "external"))
    return m.select(F.col("a").alias("dialect"), F.col("b").alias("reference"), rounded(1 - F.col("d")).alias("similarity"))


@query("SELECT a.lang AS target, a.source AS source_a, b.source AS source_b FROM (SELECT DISTINCT lang, source FROM documents) a JOIN (SELECT DISTINCT lang, source FROM documents) b ON a.lang = b.lang AND a.source < b.source")
def jn9_source_pairs(spark, sf):
    s = table(spark, sf, "documents").select(F.col("lang").alias("target"), "source").distinct()
    x, y = s.withColumnRenamed("source", "source_a"), s.withColumnRenamed("source", "source_b")
    return x.join(y, "target").where("source_a < source_b")


@query("WITH t AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS w FROM conversations), v AS (SELECT w, count(*) AS x FROM t WHERE w <> '' GROUP BY w HAVING count(*) > 1) SELECT conv_id, turn::BIGINT AS turn, count(*)::BIGINT AS n, round(avg(x), 6) AS x FROM t JOIN v USING (w) GROUP BY ALL")
def jn10_token_lookup(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode(F.split(F.lower("text"), " ")).alias("w")).where("w <> ''")
    v = t.groupBy("w").agg(F.count(F.lit(1)).alias("x")).where("x > 1")
    return t.join(v, "w").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("x"))


@query(f"WITH {METHODS} SELECT method, a, b, rank() OVER (PARTITION BY method ORDER BY round(d, 2)) + (count(*) OVER (PARTITION BY method, round(d, 2)) - 1) / 2.0 AS r FROM mm WHERE a < b")
def rnk3_average_rank(spark, sf):
    m = method_distances(spark, sf).where("a < b").withColumn("d", F.round("d", 2))
    return m.select("method", "a", "b", R.average_rank("d", ["method"]).alias("r"))


@query("WITH n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents), k AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM n GROUP BY lang)) SELECT lang, doc_id FROM n, k WHERE pos < c")
def st20_align_to_shortest(spark, sf):
    d = table(spark, sf, "documents").select("lang", "doc_id")
    at = d.withColumn("pos", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1)
    least = d.groupBy("lang").count().agg(F.min("count").alias("c"))
    return at.join(F.broadcast(least), F.col("pos") < F.col("c")).select("lang", "doc_id")  # least is one row


@query(f"WITH {METHODS}, j AS (SELECT x.method AS method_a, y.method AS method_b, corr(x.d, y.d) AS r FROM mm x JOIN mm y ON x.a = y.a AND x.b = y.b AND x.method < y.method WHERE x.a < x.b GROUP BY ALL) SELECT method_a, method_b, round(r, 6) AS r, r > 0.3 AS related FROM j")
def st13_cross_method_table(spark, sf):
    m = method_distances(spark, sf).where("a < b")
    x, y = m.withColumnsRenamed({"method": "method_a", "d": "dx"}), m.withColumnsRenamed({"method": "method_b", "d": "dy"})
    r = x.join(y, ["a", "b"]).where("method_a < method_b").groupBy("method_a", "method_b").agg(F.corr("dx", "dy").alias("r"))
    return r.select("method_a", "method_b", rounded("r").alias("r"), (F.col("r") > 0.3).alias("related"))

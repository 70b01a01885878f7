"""How queries see the tables, in both languages: sentences, groups, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import vectors

DIMS = 64


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sentences(spark, sf: str) -> DataFrame:
    """(doc_id, code, source, pos, text): the lines of the documents."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("code"), "source", "text")
    return docs.select("doc_id", "code", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


SENTENCES = "s AS (SELECT doc_id, lang AS code, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents)"


#: In SQL, what a letter, digit or underscore of any script is not, and white space of any script.
NO_WORD, BLANK = r"[^\p{L}\p{N}_]", r"[\t-\r \x{85}\p{Z}]"


def roman(text: str, instead: str) -> str:
    """SQL: upper-case Roman numerals that stand alone replaced. A match takes the characters beside it along, so
    every second of several in a row is left to the second pass."""
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|{NO_WORD})[IVXLCDM]{{2,}}($|{NO_WORD})', '\\1{instead}\\2', 'g')"
    return text


def family(c: Column) -> Column:
    return F.concat(F.lit("f"), (c % 4).cast("string"))


def role(c: Column) -> Column:
    return F.when(c < 4, "dialect").when(c == 4, "italian").otherwise("external")


FAM = "('f' || ({0} % 4)::VARCHAR)"
ROLE = "(CASE WHEN {0} < 4 THEN 'dialect' WHEN {0} = 4 THEN 'italian' ELSE 'external' END)"


def embeddings(spark, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("code"), F.col("embedding").alias("vec"))


def group_vectors(spark, sf: str) -> DataFrame:
    return vectors.centroids(embeddings(spark, sf), ["code"], "vec", DIMS)


def distances(spark, sf: str) -> DataFrame:
    """(a, b, d) between the groups' centroids."""
    return vectors.cosine_distances(group_vectors(spark, sf), "code")


def method_distances(spark, sf: str, methods: int = 4) -> DataFrame:
    """(method, a, b, d): each method sees its own stretch of the dimensions."""
    c = group_vectors(spark, sf)
    width = DIMS // methods
    parts = F.explode(F.array(*[F.struct(F.lit(f"m{k}").alias("method"), F.slice("vec", k * width + 1, width).alias("vec")) for k in range(methods)]))
    return vectors.cosine_distances(c.select("code", parts.alias("p")).select("code", "p.method", "p.vec"), "code", ["method"])


DISTANCES = """e AS (SELECT label AS code, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
c AS (SELECT code, list(x ORDER BY i) AS vec FROM e GROUP BY code),
m AS (SELECT x.code AS a, y.code AS b, CASE WHEN x.code = y.code THEN 0.0::DOUBLE ELSE greatest(0.0, 1 - list_cosine_similarity(x.vec, y.vec)) END AS d FROM c x, c y)"""
METHODS = """e AS (SELECT label AS code, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
cm AS (SELECT 'm' || ((i - 1) // 16)::VARCHAR AS method, code, list(x ORDER BY i) AS vec FROM e GROUP BY ALL),
mm AS (SELECT x.method, x.code AS a, y.code AS b, CASE WHEN x.code = y.code THEN 0.0::DOUBLE ELSE greatest(0.0, 1 - list_cosine_similarity(x.vec, y.vec)) END AS d FROM cm x JOIN cm y USING (method))"""
H32 = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


def rounded(c: str | Column, n: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)

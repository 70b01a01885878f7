"""Readers that turn corpus files into long tables with explicit positions. Paths may be anything that Spark opens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text

ARTICLE = "id string, url string, title string, text string"


def parallel(spark: SparkSession, path: str, codes: list[str], keys: list[str], sep: str = ",", literal_nan: bool = False) -> DataFrame:
    """(keys, code, text) of a wide table with a column per variety; absent columns are skipped, empty cells dropped
    (or the string "nan" on request). Fails if the varieties differ in length."""
    wide = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    there = [c for c in codes if c in wide.columns]
    long = wide.unpivot(keys, there, "code", "text")
    long = long.withColumn("text", F.coalesce("text", F.lit("nan"))) if literal_nan else long.where("text IS NOT NULL")
    if long.groupBy("code").count().select("count").distinct().limit(2).count() > 1:
        raise ValueError("the varieties of a parallel corpus differ in length")
    return long


def beside(spark: SparkSession, path: str, column: str, others: list[str], sep: str = ",") -> DataFrame:
    """(column, code, text): each of the other columns that the table has, next to one that all rows share."""
    wide = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    return wide.unpivot([column], [c for c in wide.columns if c in others], "code", "text")


def monolingual(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, article_id) with the rows that have a text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema="text string, label int, article_id long").na.drop(subset=["text"])


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, title, text) of JSON lines in all folders below a path; blank texts are left out."""
    raw = spark.read.schema(ARTICLE).option("recursiveFileLookup", "true").json(path)
    return raw.where(F.length(F.trim("text")) > 0).select(F.col("id").cast("long").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "text")


def texts_by_id(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a parquet file, in order of ids; fails without those columns, or where an id occurs twice."""
    found = spark.read.parquet(path)
    if missing := [c for c in ("id", "text") if c not in found.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    if not found.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError(f"an id occurs more than once in {path}")
    return found.select("id", "text").orderBy("id")


#: Where the files of each variant of a dataset lie below a corpus folder.
VARIANTS = {
    "flores": {"native": "flores/{code}.csv", "normalized": "flores_normalized/{code}.csv"},
    "oldi": {"native": "oldi/{code}.csv", "normalized": "oldi_normalized/{code}.csv"},
    "wiki": {"native": "wiki_native/{code}/{code}.csv", "normalized": "wiki/{code}/{code}.csv"},
}


def variant_path(root: str, dataset: str, variant: str, code: str = "*", layout: dict[str, dict[str, str]] = VARIANTS) -> str:
    """The file of a variety in one variant of a dataset (of all varieties: `*`); unknown names are an error."""
    if dataset not in layout:
        raise ValueError(f"unknown dataset {dataset!r}; one of {', '.join(layout)}")
    if variant not in layout[dataset]:
        raise ValueError(f"unknown variant {variant!r} of {dataset}; one of {', '.join(layout[dataset])}")
    return f"{root.rstrip('/')}/{layout[dataset][variant].format(code=code)}"


def monolingual_variant(spark: SparkSession, root: str, dataset: str, variant: str, codes: list[str], layout: dict[str, dict[str, str]] = VARIANTS) -> DataFrame:
    """(code, text, label, article_id) of the given varieties, each from its own file, named by it."""
    paths = [variant_path(root, dataset, variant, c, layout) for c in codes]
    rows = spark.read.csv(paths, header=True, multiLine=True, escape='"', schema="text string, label int, article_id long")
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("code"), "text", "label", "article_id").where("text IS NOT NULL")


def splits(parts: dict[str, DataFrame], keys: list[str], text_col: str = "text") -> DataFrame:
    """(split, keys, text): the splits of a corpus on top of each other, line ends in texts as blanks."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("split"), *keys, F.regexp_replace(text_col, r"\r?\n", " ").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def delimiter(head: str) -> str:
    """Of a header line: a tab where the first column is `id` before one, else the most frequent of tab, comma and
    semicolon outside quotes; a comma where there is none."""
    if "\t" in head and head.split("\t")[0].strip('"').lower() == "id":
        return "\t"
    bare = "".join(head.split('"')[::2])
    return max("\t,;", key=lambda c: (bare.count(c), c == ",")) if any(c in bare for c in "\t,;") else ","


def column(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(text) of one column of a table file, empty where a row lacks it; an unknown name is an error that lists those
    there are. Only the first line is looked at to find the delimiter."""
    first = spark.read.text(path).limit(1).collect()
    sep = delimiter(first[0][0] if first else "")
    wide = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    if name not in wide.columns:
        raise ValueError(f"no column {name!r} in {path}; there are {', '.join(wide.columns)}")
    return wide.select(F.coalesce(F.col(f"`{name}`"), F.lit("")).alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, text) of text files, a sentence a line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("pos", "text"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target, pos, pred) of files SRC-to-TGT.txt: trailing blank lines dropped, lines cleaned."""
    from pyspark.sql import Window

    rows = lines(spark, f"{folder}/*-to-*.txt")
    last = F.max(F.when(F.trim("text") != "", F.col("pos"))).over(Window.partitionBy("file"))
    name = lambda i: text.language_code(F.regexp_extract("file", r"^([A-Za-z]{2,10})-to-([A-Za-z]{2,20})\.txt$", i))
    return rows.withColumn("last", last).where("pos <= last").select(name(1).alias("source"), name(2).alias("target"), "pos", text.clean_prediction("text").alias("pred"))


def gold_table(spark: SparkSession, path: str) -> DataFrame:
    """(pos, target, ref) of a CSV or TSV with a column per language; names become codes, cells are trimmed."""
    head = spark.read.text(path).first()[0]
    wide = spark.read.csv(path, header=True, sep="," if head.count(",") >= head.count("\t") and "," in head else "\t", multiLine=True, escape='"')
    names = wide.columns
    rows = wide.select(F.monotonically_increasing_id().alias("_id"), *names)
    long = rows.unpivot(["_id"], names, "target", "ref")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("target").orderBy("_id")) - 1
    return long.select(pos.alias("pos"), text.language_code("target").alias("target"), F.trim(F.coalesce("ref", F.lit(""))).alias("ref"))


def square_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d) of a square CSV whose first column holds the codes."""
    wide = spark.read.csv(path, header=True)
    first, *codes = wide.columns
    return wide.withColumnRenamed(first, "a").unpivot(["a"], codes, "b", "d").select("a", "b", F.col("d").cast("double").alias("d"))


def wordlist(spark: SparkSession, path: str) -> DataFrame:
    """(n, concept_en, code, form): the first form of every cell, before a comma and a slash."""
    wide = spark.read.csv(path, header=True)
    long = wide.unpivot(["n", "concept_en"], [c for c in wide.columns if c not in ("n", "concept_en")], "code", "form")
    return long.select("n", "concept_en", "code", F.trim(F.split(F.split(F.coalesce("form", F.lit("")), ",")[0], "/")[0]).alias("form"))


def model_paths(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, method, experiment, variant, model_id) of result files below a root, folders that begin with an
    underscore left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path")
    parts = F.split(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", ""), "/")
    kept = found.withColumn("p", parts).where(~F.exists("p", lambda x: x.startswith("_")))
    return kept.select("path", F.get("p", F.lit(0)).alias("method"), F.get("p", F.lit(1)).alias("experiment"), F.array_join(F.slice("p", 3, F.greatest(F.size("p") - 3, F.lit(0))), "/").alias("variant"), F.array_join(F.slice("p", 1, F.size("p") - 1), "__").alias("model_id"))


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table, row, col, cell) of every table cell of HTML pages."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit("(?is)<table.*?</table>"), F.lit(0))).alias("table", "x"))
    rows = tables.select(key, "table", F.posexplode(F.regexp_extract_all("x", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "x"))
    return rows.select(key, "table", "row", F.posexplode(F.regexp_extract_all("x", F.lit("(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1))).alias("col", "x")).select(key, "table", "row", "col", text.clean_cell("x").alias("cell"))

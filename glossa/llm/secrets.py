"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong secrets are reported where they stand. Weak parts (a login name, a random-looking token, an endpoint) say
little alone: an interval join within each text links the parts that stand close together, and a weak part is
reported only when parts that complement it are near: an identifier needs a secret, a secret an identifier, an
endpoint both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored, text_key
from glossa.llm.spans import clear_of, count, in_order, joined, with_spans

#: Parts whose spans are at most so many code points apart are in one scope.
SCOPE = 200
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": ASSIGNED + r"[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "weak_id": r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|e?mail)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}+""",
    "weak_secret": r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}+",
    "endpoint": r"""(?:(?:https?|ftp|jdbc:[a-z0-9]++|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]++|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}+)""",
}
ROLES = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}
BASE = KINDS[:3]


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, base, weak): spans of every kind; weak ones that touch a base span are that span's business."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key("text"))
    for kind in KINDS:
        df = with_spans(df, "text", kind, kind, PATTERNS[kind])
    long_enough = F.filter("assign", lambda s: F.length(F.regexp_replace(s["text"], "^" + ASSIGNED, "")) >= 6)
    df = df.select("doc_id", "key", F.concat(long_enough, "access", "hex").alias("base"), F.concat(*KINDS[3:]).alias("weak"))
    return df.withColumn("weak", clear_of(F.col("weak"), F.col("base")))


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, extra): weak spans with complementary parts in scope, per distinct text.

    The interval join is an equi-join on text and bin of `scope` code points: one side stands in the bins that it
    covers, the other also in those that its scope reaches. A bin holds no more parts than fit into it.
    """
    role = F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])
    parts = found.where("size(weak) > 0").select("key", F.explode(F.concat("base", "weak")).alias("s")).select("key", "s.kind", "s.start", "s.end").distinct().withColumn("role", role[F.col("kind")])
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope).cast("int"), F.floor(hi / scope).cast("int")))
    weak = parts.where(~F.col("kind").isin(BASE)).withColumn("bin", bins(F.col("start"), F.col("end") - 1)).alias("w")
    near = parts.withColumn("bin", bins(F.col("start") - scope, F.col("end") - 1 + scope)).alias("n")
    met = weak.join(near, (F.col("w.key") == F.col("n.key")) & (F.col("w.bin") == F.col("n.bin")) & (F.col("w.role") != F.col("n.role")) & (F.col("n.start") <= F.col("w.end") + scope) & (F.col("w.start") <= F.col("n.end") + scope))
    has = lambda r: F.max((F.col("n.role") == r).cast("int")).alias(r)
    seen = met.groupBy("w.key", "w.kind", "w.start", "w.end").agg(has("id"), has("secret"))
    kept = seen.where("CASE kind WHEN 'weak_id' THEN secret = 1 WHEN 'weak_secret' THEN id = 1 ELSE id = 1 AND secret = 1 END")
    return kept.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end", F.lit("").alias("text"))).alias("extra"))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): base secrets, and those with linked weak parts added, in order.

    A null text is empty and has none; a very long one is searched whole, in time that grows a little faster than its
    matches. Rows stay rows (repeated and null ids too); equal texts get equal spans; spans that begin at one place
    come in the order of kinds; an empty table gives an empty result; other columns, whatever their names, are
    ignored. Rows without a weak part take no part in the join; what it adds is stored, so that the rows of a text
    with very many copies can be split.
    """
    found = stored(found_spans(docs, id_col, text_col), "secrets")
    extra = stored(linked_parts(found, scope), "linked")
    alone = found.where("size(weak) = 0").select("doc_id", "base", F.col("base").alias("all"))
    more = found.where("size(weak) > 0").join(extra, "key", "left").select("doc_id", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra")).alias("all"))
    return alone.unionByName(more).select("doc_id", in_order(F.col("base"), KINDS).alias("base"), in_order(F.col("all"), KINDS).alias("spans"))


def op5_credential_linking(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [count(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

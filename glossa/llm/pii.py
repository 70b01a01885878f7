"""Personal data by pattern, and terms that give it away by information-theoretic sanitisation; DataFrame operations only.

Corpus statistics are taken twice: over all distinct lines of all documents (a copied line is no new evidence) and
over all distinct documents (a line that different documents share is; a copied document is not). For an entity c (an
address, a number) and a term t, PMI(c, t) = log p(c, t) / p(c) p(t) is what t tells about c, and IC(c) = -log p(c) is
all there is to tell. A term whose share PMI / IC exceeds the disclosure threshold in either count, on enough lines or
documents, reveals the entity: it is generalised throughout every document that holds the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored, text_key
from glossa.llm.spans import clear_of, computed, count, in_order, joined, running, with_spans

#: Share of an entity's information that a term may give, and the lines (or documents) that must hold both at least.
DISCLOSURE = 0.8
MIN_LINES = 3
#: Code points of the parts that a text is cut into to take it apart.
PART = 1024
KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = KINDS[:4]
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
WORD = r"[\p{L}\p{M}\p{Nd}]+"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right counts double, nines cast out."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `base`: the spans of the four kinds that pass their checks."""
    for kind in BASE:
        df = with_spans(df, text, kind, kind, PATTERNS[kind])
    ip = F.filter("ip", lambda s: s["text"].rlike(OCTETS))
    card = F.filter("card", lambda s: luhn(digits(s["text"])))
    phone = F.filter("phone", lambda s: F.length(digits(s["text"])).between(10, 15))
    return computed(df.withColumn("base", F.concat("email", ip, card, phone)).drop(*BASE), "base")


def entity(span: Column) -> Column:
    """One name for one entity, however it is written."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), digits(span["text"])).otherwise(F.lower(span["text"])))


def terms_of(line: Column) -> Column:
    """Distinct lower-cased words of a line, four letters or digits and more, one of them a letter."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)), lambda w: (F.length(w) >= 4) & w.rlike(r"\p{L}")))


def telling(pairs: DataFrame, words: DataFrame, n: int, disclosure: float, min_lines: int) -> DataFrame:
    """(entity, term) from a row (entity, n_c, term) per context that holds both and a row (term) per context and term,
    over n contexts."""
    both = pairs.groupBy("entity", "n_c", "term").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= min_lines)
    wanted = both.select("term").distinct()
    often = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") >= min_lines).join(wanted, "term")
    told = F.log(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t"))) / F.log(F.lit(float(n)) / F.col("n_c"))
    return both.join(often, "term").where((F.col("n_c") < n) & (told >= disclosure)).select("entity", "term")


def tested(bearing: DataFrame, min_lines: int) -> DataFrame:
    """(entity, n_c): entities on fewer than min_lines contexts have no terms to test. Stored, so that the contexts of
    an entity that very many have can be split where they are joined."""
    return stored(bearing.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).where(F.col("n_c") >= min_lines), "entities")


def disclosing_terms(lines: DataFrame, disclosure: float = DISCLOSURE, min_lines: int = MIN_LINES) -> DataFrame:
    """(entity, term) over a table of distinct lines."""
    marked = with_base(lines.where(F.col("line").rlike("[@0-9]")), "line").where("size(base) > 0")
    bearing = marked.select("line", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))
    pairs = bearing.join(tested(bearing, min_lines), "entity").select("entity", "n_c", F.explode(terms_of(F.col("line"))).alias("term"))
    words = lines.select(F.explode(terms_of(F.col("line"))).alias("term"))
    return telling(pairs, words, lines.count(), disclosure, min_lines)


def disclosing_in_documents(docs: DataFrame, keys: DataFrame, bearing: DataFrame, units: DataFrame, disclosure: float, min_lines: int, text_col: str) -> DataFrame:
    """(entity, term) over distinct texts; keys: (key) of every row, bearing: (key, entity), units: (key, text) of the
    texts with entities. Only texts that have copies cross the network to be counted once."""
    copied = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "copied")
    texts = docs.where(F.length(F.trim(text_col)) > 0).select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    n = texts.select("key").distinct().count()
    once = texts.join(copied, "key", "left_anti").select("text")
    again = texts.join(copied, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("text")
    words = once.union(again).select(F.explode(terms_of(F.col("text"))).alias("term"))
    held = bearing.join(tested(bearing, min_lines), "entity").groupBy("key").agg(F.collect_list(F.struct("entity", "n_c")).alias("held"))
    each = units.join(held, "key").select("held", F.explode(terms_of(F.col("text"))).alias("term"))
    return telling(each.select("term", F.explode("held").alias("x")).select("x.entity", "x.n_c", "term"), words, n, disclosure, min_lines)


def detected(docs: DataFrame, disclosure: float = DISCLOSURE, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, base, spans): spans of the four kinds, and of all with disclosing terms, in order.

    A null text is empty and has none; a very long one is searched whole. Rows stay rows (repeated and null ids too);
    equal texts get equal spans; spans that begin at one place come in the order of kinds; an empty table gives an
    empty result; other columns, whatever their names, are ignored.
    """
    df = with_base(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key("text")))
    table = stored(df.select("doc_id", "key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "pii")
    units = table.where("text IS NOT NULL").groupBy("key").agg(F.first("text").alias("text"))
    bearing = table.where("text IS NOT NULL").select("key", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity")).distinct()
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).where(F.length(F.trim("line")) > 0).groupBy("line").agg(F.lit(1).alias("one")).select("line")
    on_lines = disclosing_terms(stored(lines, "lines"), disclosure, min_lines)
    told = stored(on_lines.union(disclosing_in_documents(docs, table.select("key"), bearing, units, disclosure, min_lines, text_col)).distinct(), "terms")
    known = units.join(bearing.join(told, "entity").groupBy("key").agg(F.collect_set("term").alias("terms")), "key")
    placed = computed(with_spans(known, "text", "words", "term", WORD), "words")
    extra = placed.select("key", F.filter("words", lambda w: F.array_contains("terms", F.lower(w["text"]))).alias("extra")).where("size(extra) > 0")
    extra = stored(extra, "marks")
    bare = table.where("text IS NULL").select("doc_id", "key", "base", F.col("base").alias("all"))
    every = table.where("text IS NOT NULL").select("doc_id", "key", "base").join(extra, "key", "left")
    every = every.select("doc_id", "key", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", clear_of(F.col("extra"), F.col("base")))).alias("all"))
    return bare.unionByName(every).select("doc_id", "key", in_order(F.col("base"), KINDS).alias("base"), in_order(F.col("all"), KINDS).alias("spans"))


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with every span replaced by its kind in brackets ([EMAIL], [IP], [CARD], [PHONE], [TERM]); overlapping
    spans become one mark, of the first's kind. Rows and columns stay; n_chars, where there is one, follows the text."""
    found = detected(docs, disclosure, min_lines).where("size(spans) > 0")
    spans = stored(found.groupBy(F.col("key").alias("k")).agg(F.first("spans").alias("spans")), "masks")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("text"), text_key("text").alias("k")).join(spans, "k", "left")
    rows = rows.withColumn("ends", F.transform("spans", lambda s: s["end"]))
    reach = running(F.col("ends"), lambda a, x: F.greatest(a, x), F.lit(0))
    apart = F.filter(F.arrays_zip(F.col("spans").alias("s"), reach.alias("from")), lambda x: x["s"]["start"] >= x["from"])
    rows = rows.withColumn("parts", F.when(F.col("spans").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))).withColumn("apart", apart)

    def between(start: Column, end: Column) -> Column:
        """Code points start..end of the text, from the parts that hold them: a long text is not walked from its beginning."""
        first = F.floor(start / PART).cast("int")
        held = F.array_join(F.slice(F.col("parts"), first + 1, F.floor(end / PART).cast("int") - first + 1), "")
        return F.substring(held, start % PART + 1, end - start)

    pieces = F.transform("apart", lambda x: F.concat(between(x["from"], x["s"]["start"]), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]")))
    rest = between(F.array_max("ends"), F.length("text"))
    rows = rows.withColumn("new", F.when(F.col("spans").isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")))
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("spans").isNotNull(), F.length("new")).otherwise(F.col("row")["n_chars"])} if "n_chars" in docs.columns else {"text": F.col("new")}
    return rows.select(*[(changed[c].cast(docs.schema[c].dataType) if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op7_disclosure_sanitiser(spark, sf_dir: str) -> DataFrame:
    out = detected(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [count(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""Spans of regular expressions as native column expressions: positions in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,text:string>>"


def running(values: Column, combine, zero: Column) -> Column:
    """For each value, all before it combined. In stretches of about the square root of their number, as an array that
    grows value by value is copied each time."""
    n = F.size(values)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(16))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0))), lambda k: F.slice(values, k * width + 1, width))
    none = F.slice(values, 1, 0)
    step = lambda a, x: F.struct(combine(a["all"], x).alias("all"), F.concat(a["out"], F.array(a["all"])).alias("out"))
    inner = F.transform(parts, lambda p: F.aggregate(p, F.struct(zero.alias("all"), none.alias("out")), step))
    outer = F.aggregate(inner, F.struct(zero.alias("all"), none.alias("out")), lambda a, x: step(a, x["all"]))["out"]
    return F.flatten(F.zip_with(inner, outer, lambda x, before: F.transform(x["out"], lambda v: combine(before, v))))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, by sorting: a span overlaps as many others as begin before its end
    less those that end before its start."""

    def before(of, mine: int, edge) -> Column:
        """For each span, in order of its number, how many of the others lie before its edge."""
        own = F.transform(spans, lambda s, i: F.struct(of(s).alias("at"), F.lit(mine).alias("first"), i.alias("number")))
        all_of = F.sort_array(F.concat(own, F.transform(others, lambda s: F.struct(edge(s).alias("at"), F.lit(1 - mine).alias("first"), F.lit(-1).alias("number")))))
        placed = F.filter(F.transform(all_of, lambda x, i: F.struct(x["number"].alias("number"), i.alias("i"))), lambda x: x["number"] >= 0)
        return F.transform(F.sort_array(F.transform(placed, lambda x, k: F.struct(x["number"].alias("number"), (x["i"] - k).alias("n")))), lambda x: x["n"])

    begun, over = before(lambda s: s["end"], 0, lambda s: s["start"]), before(lambda s: s["start"], 1, lambda s: s["end"])
    free = F.zip_with(begun, over, lambda a, b: a == b)
    kept = F.transform(F.filter(F.arrays_zip(spans.alias("s"), free.alias("free")), lambda x: x["free"]), lambda x: x["s"])
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(kept)


def with_spans(df: DataFrame, text: str, out: str, kind: str, pattern: str) -> DataFrame:
    """Adds all leftmost non-overlapping matches of a pattern (without empty matches) as spans of a kind.

    Splitting by the pattern gives what stands between the matches; only texts with a match are split. A match starts
    after all gaps and matches before it and the gap beside it.
    """
    found, gaps, steps = f"_{out}_found", f"_{out}_gaps", f"_{out}_steps"
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    none = F.expr("cast(array() as array<int>)")
    between = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, between).otherwise(none))
    df = df.withColumn(steps, F.zip_with(gaps, found, lambda g, m: g + F.length(m)))
    at = F.zip_with(running(F.col(steps), lambda a, x: a + x, F.lit(0)), gaps, lambda a, g: a + g)
    spans = F.zip_with(F.col(found), at, lambda m, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("text")))
    return df.withColumn(out, F.when(F.size(found) > 0, spans).otherwise(F.expr(f"cast(array() as {SPAN})"))).drop(found, gaps, steps)


def computed(df: DataFrame, col: str) -> DataFrame:
    """df with a column that filters above are not moved into: those would compute its whole expression once more."""
    return df.withColumn(col, F.explode(F.array(col)))


def in_order(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by kind as listed, then by end."""
    listed = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(listed, s["kind"]).cast("int").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

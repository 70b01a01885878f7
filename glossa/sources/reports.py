"""Readable files of finished evaluations: tables with a row a group or pair of groups, written through Spark's file
systems. Rows stream to the driver in order; what is listed without end is cut by head and tail, never by chance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.relational import head_tail

RULE = "=" * 60


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> str:
    """One file, written beside its place and moved there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(staged, True)
    for line in lines:
        out.write(bytearray(f"{line}\n".encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(staged, where):
        raise OSError(f"{path} could not be written")
    return path


def number(v, digits: int = 4, sign: str = "") -> str:
    return "n/a" if v is None or v != v else f"{v:{sign}.{digits}f}"


def csv_lines(df: DataFrame, digits: int = 6) -> Iterable[str]:
    """Header and rows; cells with commas, quotes or line ends are quoted."""

    def cell(v) -> str:
        s = "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s

    yield ",".join(map(cell, df.columns))
    for r in df.toLocalIterator():
        yield ",".join(map(cell, r))


def two_sections(overall: DataFrame, each: DataFrame) -> Iterable[str]:
    """Metrics of the whole clustering, then those of each variety, in one file."""
    yield "# Global clustering metrics"
    yield from csv_lines(overall)
    yield ""
    yield "# Per-variety silhouette scores"
    yield from csv_lines(each)


def aligned(df: DataFrame, digits: int = 4) -> Iterable[str]:
    rows = [df.columns, *([number(v, digits) if isinstance(v, float) else str(v) for v in r] for r in df.toLocalIterator())]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return ["  ".join(x.rjust(w) for x, w in zip(r, widths, strict=True)) for r in rows]


def silhouette_report(label: str, n: int, scores: dict[str, float | None], each: DataFrame) -> Iterable[str]:
    """each: (code, family, silhouette)."""
    yield f"Silhouette report ({label})"
    yield RULE
    yield f"  n_varieties = {n}"
    for name, v in scores.items():
        yield f"  silhouette ({name}) = {number(v, sign='+')}"
    yield ""
    yield "Silhouette range [-1, 1]: above 0.5 excellent, above 0.2 good, about 0 no structure."
    yield ""
    yield "Per-variety silhouette scores, best first:"
    yield from aligned(each.orderBy(F.desc("silhouette"), "code").select("code", "family", "silhouette"))


def alignment_report(label: str, pairs: DataFrame, each: DataFrame, n_sentences: int, head: int = 20, tail: int = 10) -> Iterable[str]:
    """pairs: (a, b, similarity); each: (code, mean)."""
    yield f"Parallel alignment report ({label})"
    yield RULE
    yield f"  n_varieties = {each.count()}"
    yield f"  n_sentences = {n_sentences}"
    ranked = head_tail(pairs, [("similarity", True), ("a", False), ("b", False)], head, tail)
    for part, title in (("head", f"Top {head} most-aligned variety pairs:"), ("tail", f"Bottom {tail} least-aligned pairs:")):
        yield ""
        yield title
        yield from aligned(ranked.where(F.col("part") == part).orderBy("place").select("a", "b", "similarity"))
    yield ""
    yield "Per-variety mean alignment to all others, best first:"
    yield from aligned(each.orderBy(F.desc("mean"), "code").select("code", "mean"))


def gold_readme(files: list[str], dialects: list[str], middle: list[str], external: list[str]) -> Iterable[str]:
    """What the correlation tables beside it mean; the files are listed in order."""
    yield "# Correlations with gold matrices"
    yield ""
    yield "A table for each gold matrix. `full`: Spearman's rho over all pairs of shared varieties, from -1 to 1;"
    yield "`dialect_external`: over pairs of a dialect and an external variety only. A high rho means that a method's"
    yield "distances order the pairs as the gold does."
    yield ""
    for name, codes in (("dialect", dialects), ("left out of the second", middle), ("external", external)):
        yield f"* {name}: {', '.join(codes) or 'none'}"
    yield ""
    yield "## Files"
    yield ""
    yield from (f"* `{f}`" for f in sorted(files))

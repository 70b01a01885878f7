"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored


class Forest:
    """Union-find over things numbered as they come; the root of a tree is its smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        y = up.setdefault(x, x)
        while y != x:
            up[x] = up[y]
            x, y = y, up[y]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple]:
        """(thing, root) of all that are not roots."""
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def contracted(edges: DataFrame, rows: int = 200_000) -> DataFrame:
    """The same components by fewer edges: each stretch of a partition becomes stars."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Forest(), 0
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.join(x, y)
            n += b.num_rows
            if n >= rows:
                yield from out(found, b.schema)
                found, n = Forest(), 0
        if n:
            yield from out(found, b.schema)

    def out(found: Forest, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if pairs := found.edges():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), schema.field(0).type) for c in zip(*pairs, strict=True)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


#: Rows of a narrow table that one task takes; tables of fewer rows need no exchange at all.
TASK_ROWS = 200_000


def dealt(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """A table of about so many rows in no more partitions than they make tasks."""
    return df.coalesce(max(1, -(-rows // task_rows)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's smallest node.

    Each round hangs neighbours on the smallest one they know: only minima per node are aggregated, never lists of
    neighbours, so a node with very many of them does no harm. Every round is written to the shared folder; the
    number of tasks follows the number of edges.
    """
    tell = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = stored(contracted(edges.where("a <> b")), "edges")  # a > b
    known = tell(now)
    while known[0]:
        rows = 2 * known[0]
        both = dealt(now.select("a", "b").unionAll(now.select("b", "a")), rows)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = dealt(large, rows)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").select("b", "m").unionAll(small.select("a", "m")).toDF("a", "b")
        now = stored(dealt(hung.where("a <> b"), rows).distinct(), "edges")
        before, known = known, tell(now)
        if known == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stored(dealt(now.toDF("node", "root").unionAll(roots), 2 * known[0]).distinct(), "components")

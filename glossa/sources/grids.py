"""HTML tables as dense grids, and word lists from the tables of appendices.

Cells that span rows or columns are repeated in each place they cover, so that a column is a column in every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text

#: Largest span that is followed; browsers stop there too.
SPAN = 1000


class _Tables(HTMLParser):
    """Tables in order of their beginning; cells as raw HTML with their spans. Inner tables are tables of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.tables: list[list[list[tuple[int, int, list[str]]]]] = []
        self.open: list[tuple[list, list | None]] = []
        self.cell: list[list[str] | None] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append((self.tables[-1], None))
            self.cell.append(None)
        elif self.open and tag == "tr":
            self.cell[-1] = None
            self.open[-1][0].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1][0]:
                self.open[-1][0].append([])
            span = lambda name: max(1, min(SPAN, int(v))) if (v := (dict(attrs).get(name) or "1").strip()).isdigit() else 1
            self.cell[-1] = []
            self.open[-1][0][-1].append((span("rowspan"), span("colspan"), self.cell[-1]))
        else:
            self.handle_data(self.get_starttag_text() or "")

    def handle_startendtag(self, tag, attrs):
        self.handle_data(self.get_starttag_text() or "")

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
            self.cell.pop()
        elif tag in ("td", "th", "tr") and self.open:
            self.cell[-1] = None
        else:
            self.handle_data(f"</{tag}>")

    def handle_data(self, data):
        if self.cell and self.cell[-1] is not None:
            self.cell[-1].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def grid(rows: list[list[tuple[int, int, str]]]) -> list[list[str]]:
    """Rows of (rowspan, colspan, cell) as a grid; a span does not reach below the last row."""
    out: list[list[str]] = []
    below: dict[int, tuple[int, str]] = {}
    for cells in rows:
        line: dict[int, str] = {c: x for c, (_, x) in below.items()}
        below = {c: (n - 1, x) for c, (n, x) in below.items() if n > 1}
        col = 0
        for down, across, x in cells:
            while col in line:
                col += 1
            for c in range(col, col + across):
                line.setdefault(c, x)
                if down > 1 and c not in below:
                    below[c] = (down - 1, x)
            col += across
        out.append([line.get(c, "") for c in range(max(line, default=-1) + 1)])
    return out


def tables_of(page: str | None) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(page or "")
    p.close()
    return [grid([[(d, a, "".join(x)) for d, a, x in row] for row in t]) for t in p.tables]


def table_grids(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table, row, col, cell): every cell of every table, spans filled, cells cleaned. Null pages have none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, page in zip(b.column(0), b.column(1), strict=True):
                cells = [(t, r, c, x) for t, rows in enumerate(tables_of(page.as_py())) for r, row in enumerate(rows) for c, x in enumerate(row)]
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(cells), b.schema.field(0).type), *[pa.array(list(x), t) for x, t in zip(zip(*cells, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]], ["key", "table", "row", "col", "cell"])

    found = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, table int, row int, col int, cell string")
    return found.select(F.col("key").alias(key), "table", "row", "col", text.clean_cell("cell").alias("cell"))


@dataclass
class Appendix:
    """How the word list of one appendix is read: which table, which header each code stands under (the first that
    contains one of the strings, tried in order), and what numbers a row: its first cell, which must then be a whole
    number, or its place in the table, from 1."""

    columns: dict[str, list[str]]
    table: int = 0
    by_place: bool = False
    #: A code whose header also holds this string is not read.
    unless: dict[str, str] = field(default_factory=dict)
    #: Rows that end before a column that is read are left out; else such a form is empty.
    whole_rows: bool = False
    #: Columns without a header of theirs: the third if there is one (True), or empty forms (False).
    third: bool = False
    #: Rows that end before the column are left out for that code.
    only_held: bool = False


def word_forms(grids: DataFrame, key: str, of: Appendix) -> DataFrame:
    """(key, n, code, form) from `table_grids`. Of rows with one number the last counts."""
    t = grids.where(F.col("table") == of.table)
    header = t.where("row = 0")
    codes = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(i).alias("rank"), F.lit(s).alias("s")) for c, subs in of.columns.items() for i, s in enumerate(subs)]))
    width = header.groupBy(key).agg(F.max("col").alias("width"))
    met = header.select(key, "col", F.lower("cell").alias("head"), codes.alias("x")).where(F.contains("head", F.col("x.s"))).groupBy(key, F.col("x.code").alias("code")).agg(F.min(F.struct("x.rank", "col", "head")).alias("m"))
    for code, word in of.unless.items():
        met = met.where((F.col("code") != code) | ~F.contains("m.head", F.lit(word)))
    every = width.select(key, "width", F.explode(F.array(*map(F.lit, of.columns))).alias("code"))
    third = F.when(F.col("width") >= 2, F.lit(2)) if of.third else F.lit(None).cast("int")
    at = every.join(met, [key, "code"], "left").select(key, "code", F.coalesce("m.col", third).alias("at"))
    if of.third:
        at = at.where("at IS NOT NULL")

    body = t.where("row > 0").groupBy(key, "row").agg(F.count(F.lit(1)).alias("cells"), F.max(F.when(F.col("col") == 0, F.col("cell"))).alias("first"))
    number = F.col("row") if of.by_place else F.when(F.col("first").rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.trim("first").cast("int"))
    rows = body.select(key, "row", "cells", number.alias("n")).where("n IS NOT NULL")
    if not of.by_place:
        rows = rows.where("cells >= 2")
    if of.whole_rows:
        rows = rows.join(at.groupBy(key).agg(F.max("at").alias("last")), key).where(F.col("cells") > F.coalesce("last", F.lit(-1))).drop("last")
    last = Window.partitionBy(key, "n").orderBy(F.desc("row"))
    rows = rows.withColumn("_k", F.row_number().over(last)).where("_k = 1")
    out = rows.join(at, key).join(t.select(key, "row", F.col("col").alias("at"), "cell"), [key, "row", "at"], "left")
    if of.only_held:
        out = out.where("cell IS NOT NULL")
    return out.select(key, "n", "code", F.coalesce("cell", F.lit("")).alias("form"))


# The layouts of five kinds of appendices.
ITALIAN = Appendix({"concept_en": ["english"], "ita": ["italian"], "lmo": ["lombard"], "fur": ["friulian"], "vec": ["venetan"], "scn": ["sicilian"], "lij": ["ligurian"], "sc": ["sardinian"]}, whole_rows=True)
ROMANCE = Appendix({"fra": ["french"], "spa": ["spanish"], "cat": ["catalan"], "por": ["portuguese"]}, by_place=True)
OCCITAN = Appendix({"oci": ["lengadocian", "occitan"]}, table=1, by_place=True)
GERMANIC = Appendix({"deu": ["german"], "eng": ["english"]}, unless={"eng": "old"})
SLAVIC = Appendix({"slv": ["slovene"], "hrv": ["serbo-croatian"]})


def single_language(code: str, header: str) -> Appendix:
    return Appendix({code: [header]}, third=True, only_held=True)

"""Vector files, as a data source: `.npz` with `matrix`, `labels` and perhaps `meta`, and `.csv` or `.tsv` with a label
in the first column.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("arrays").load(folder)                    # (file, pos, code, vec, meta), a task per file
    df.write.format("arrays").mode("append").save(folder)       # a file per task; all of them appear, or none

Paths are those of any file system that Arrow knows. Labels and meta that only pickle can read are refused and left
empty, unless the option `pickle` is `true`: it runs code that a file brings along.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

KINDS = (".npz", ".csv", ".tsv")


def store_of(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def parsed(name: str, content: bytes, pickle: bool = False) -> Iterator[tuple[int, str, list[float], str | None]]:
    """(pos, code, vec, meta) of each row of a file; meta, JSON text, is null where it is absent or cannot be read."""
    if name.endswith(".npz"):
        with np.load(io.BytesIO(content), allow_pickle=pickle) as data:
            matrix, labels, meta = np.asarray(data["matrix"], np.float64), [str(x) for x in data["labels"]], None
            try:
                meta = json.dumps(json.loads(str(data["meta"][0])), sort_keys=True)
            except (KeyError, ValueError, IndexError, TypeError):
                meta = None
        if matrix.ndim != 2 or len(matrix) != len(labels):
            raise ValueError(f"{name}: a matrix with a row for each label is needed")
        for i, (code, row) in enumerate(zip(labels, matrix.tolist(), strict=True)):
            yield i, code, row, meta
    elif name.endswith(KINDS):
        rows = csv.reader(io.StringIO(content.decode("utf-8-sig")), delimiter="\t" if name.endswith(".tsv") else ",")
        next(rows, None)
        for i, row in enumerate(r for r in rows if r):
            yield i, row[0], [float(x) if x.strip() else float("nan") for x in row[1:]], None
    else:
        raise ValueError(f"{name}: not one of {', '.join(KINDS)}")


@dataclass
class OneFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    staged: str | None
    final: str | None


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return "file string, pos int, code string, vec array<double>, meta string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, [f.name for f in schema.fields], overwrite)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pickle = options["path"], options.get("pickle", "false").lower() == "true"

    def partitions(self) -> list[OneFile]:
        from pyarrow import fs

        store, path = store_of(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [OneFile(path)]
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(path) :].split("/"))
        return [OneFile(p) for p in sorted(f.path for f in found if f.is_file and f.path.endswith(KINDS)) if not hidden(p)]

    def read(self, partition) -> Iterator[tuple]:
        if not isinstance(partition, OneFile):
            return  # a folder without files has no partition
        store, _ = store_of(self.path)
        with store.open_input_stream(partition.path) as f:
            content = f.read()
        for pos, code, vec, meta in parsed(partition.path, content, self.pickle):
            yield partition.path.rsplit("/", 1)[-1], pos, code, vec, meta


class Writer(DataSourceWriter):
    """Each task writes a file beside the folder's files under a hidden name; the commit gives them their names."""

    def __init__(self, options, names: list[str], overwrite: bool):
        self.path, self.meta, self.overwrite = options["path"], options.get("meta"), overwrite
        self.kind = options.get("kind", "npz").lower()
        self.code, self.vec = names.index("code"), names.index("vec")
        if f".{self.kind}" not in KINDS:
            raise ValueError(f"kind is one of {', '.join(k[1:] for k in KINDS)}")

    def write(self, rows: Iterator) -> Written:
        codes, vecs = [], []
        for r in rows:
            codes.append("" if r[self.code] is None else str(r[self.code]))
            vecs.append([float("nan") if x is None else float(x) for x in r[self.vec] or []])
        if not codes:
            return Written(None, None)
        if len({len(v) for v in vecs}) > 1:
            raise ValueError("vectors of one file have one length")
        store, path = store_of(self.path)
        name = f"part-{uuid.uuid4().hex}.{self.kind}"
        store.create_dir(f"{path}/_staged", recursive=True)
        with store.open_output_stream(f"{path}/_staged/{name}") as f:
            f.write(self.content(codes, vecs))
        return Written(f"{path}/_staged/{name}", f"{path}/{name}")

    def content(self, codes: list[str], vecs: list[list[float]]) -> bytes:
        if self.kind == "npz":
            out = io.BytesIO()
            more = {"meta": np.array([self.meta])} if self.meta is not None else {}
            np.savez_compressed(out, matrix=np.array(vecs, np.float64), labels=np.array(codes), **more)
            return out.getvalue()
        text = io.StringIO()
        w = csv.writer(text, delimiter="\t" if self.kind == "tsv" else ",", lineterminator="\n")
        w.writerow(["", *range(len(vecs[0]))])
        w.writerows([c, *map(repr, v)] for c, v in zip(codes, vecs, strict=True))
        return text.getvalue().encode()

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, path = store_of(self.path)
        store.create_dir(path, recursive=True)
        new = [m for m in messages if m and m.staged]
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(KINDS)] if self.overwrite else []
        for m in new:
            store.move(m.staged, m.final)
        for p in old:
            store.delete_file(p)
        self.clear(store, path)

    def abort(self, messages: list) -> None:
        store, path = store_of(self.path)
        self.clear(store, path)

    @staticmethod
    def clear(store, path: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{path}/_staged").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_staged")


def variety_vectors(spark, path: str) -> DataFrame:
    """(file, code, vec) of a file or folder."""
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("arrays").load(path).select("file", "code", "vec")


def gold_matrices(spark, path: str) -> DataFrame:
    """(gold, a, b, d, meta): the cells of every square matrix below a path, named by its file."""
    spark.dataSource.register(ArrayFiles)
    rows = spark.read.format("arrays").load(path).select(F.regexp_replace("file", r"\.[^.]+$", "").alias("gold"), "pos", "code", "vec", "meta")
    names = rows.select("gold", F.col("pos").alias("_pos"), F.col("code").alias("b"))
    cells = rows.select("gold", F.col("code").alias("a"), F.posexplode("vec").alias("_pos", "d"), "meta")
    return cells.join(names, ["gold", "_pos"]).select("gold", "a", "b", "d", "meta")

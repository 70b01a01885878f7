"""What several training-data operators share: the shared folder, text keys, byte-level words."""

from __future__ import annotations

import contextlib
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Python-side working block; every operator that buffers text flushes at about this size.
BLOCK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all tasks run in this
    process, one of our own; a cluster without one is refused, as its executors would write where no other can read."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"/tmp/glossa-shared/{uuid.uuid4().hex}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/glossa-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What operators keep in a worker from task to task.
KEPT: list[dict] = []


def forgotten() -> None:
    """Let go of what earlier operators keep in this worker: stages of a pipeline share workers, not memories."""
    for kept in KEPT:
        kept.clear()
    gc.collect()  # a codec and its memories hold each other
    trimmed()


def trimmed() -> None:
    """Give freed memory back: a worker that waits for its next task should not hold what the last one needed."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns named by place, for functions over whole batches: names may hold dots or occur twice."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def text_key(text: str | Column = "text") -> Column:
    """128 bits that stand for a text; null and the empty text share one key."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def utf8(text: str = "text") -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def word_table(keep_digits: bool) -> bytes:
    """A bytes.translate table: A-Z lower-cased, letters (and digits) and all non-ASCII kept, the rest blank."""
    out = bytearray(b" " * 256)
    for c in range(256):
        if c >= 0x80 or 0x61 <= c <= 0x7A or (keep_digits and 0x30 <= c <= 0x39):
            out[c] = c
        elif 0x41 <= c <= 0x5A:
            out[c] = c + 32
    return bytes(out)

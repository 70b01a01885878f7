"""Masked characters for training encoders: which positions are hidden depends on keys alone, not on batches or tasks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import md5, rules, text

#: Fixed values of the encoder's alphabet: padding, begin, end, and the mark of a hidden character.
PAD, BEGIN, END, RESERVED, MASK = 0x0000, 0xE000, 0xE001, 0xE002, 0xE003
#: What a position that is not to be guessed has as its label.
IGNORED = -100
#: Characters of a sequence, begin and end included; the share of characters chosen; of those, in hundredths, how many
#: become the mark, and how many another character. The rest stay, to be guessed all the same.
LENGTH, SHARE, MARKED, CHANGED = 512, 0.15, 80, 10


#: The code points that a changed character can become, and those that are never chosen.
_POINTS = np.concatenate([np.arange(a, b + 1, dtype=np.int32) for a, b in rules.CODE_POINTS])
_FIXED = [PAD, BEGIN, END, RESERVED, MASK]
#: Characters that a task works on at a time, if no text is longer.
TOGETHER = 1 << 20


def masked(df: DataFrame, keys: list[str], text_col: str, seed: str = "42", share: float = SHARE, length: int = LENGTH, first_only: bool = False) -> DataFrame:
    """(keys, part, input_ids, attention_mask, labels): code points with begin and end, some of them hidden.

    Position i of a part is chosen, and what becomes of it, by the MD5 of seed, keys, part and i (from 0, begin
    included). Chosen positions have their vocabulary number as label, others IGNORED. A null text is empty; rows of
    equal keys are hidden alike; texts that are longer than a sequence go on in further parts, unless first_only cuts
    them as an encoder would. Begin, end, padding and marks in the text itself are never chosen.
    """
    name = F.concat_ws("-", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    rows = df.select(*keys, name.alias("_name"), F.coalesce(text_col, F.lit("")).alias("_text"))
    ints = T.ArrayType(T.IntegerType())
    made = [T.StructField("part", T.IntegerType()), T.StructField("input_ids", ints), T.StructField("labels", ints)]
    limit, room = int(share * 2**32), length - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.utf8_length(b.column(len(keys) + 1)).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // TOGETHER
            for at, to in pairwise([*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(sizes)]):
                some = b.slice(at, to - at)
                names, texts = some.column(len(keys)).to_pylist(), some.column(len(keys) + 1).to_pylist()
                row, columns = _hidden(names, [t[:room] for t in texts] if first_only else texts, limit, room)
                yield pa.RecordBatch.from_arrays([some.column(k).take(row) for k in range(len(keys))] + columns, [*keys, *(f.name for f in made)])

    got = rows.mapInArrow(run, T.StructType([df.schema[k] for k in keys] + made))
    return got.select(*keys, "part", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"), "labels")


def _hidden(names: list[str], texts: list[str], limit: int, room: int) -> tuple[pa.Array, list[pa.Array]]:
    """Of every sequence the text it belongs to, and its part, ids and labels."""
    n = np.array([len(t) for t in texts], np.int64)
    points = text.points_of("".join(texts))
    parts = np.maximum(-(-n // room), 1)
    row = np.repeat(np.arange(len(n)), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(n[row] - part * room, room)
    h = md5.numbered([f"{names[r]}-{p}-".encode() for r, p in zip(row.tolist(), part.tolist(), strict=True)], size)
    at = np.flatnonzero(h[0] < np.uint64(limit))
    at = at[~np.isin(points[at], _FIXED)]
    what, was = h[1][at] % 100, points[at]
    points[at] = np.where(what < MARKED, MASK, np.where(what < MARKED + CHANGED, _POINTS[h[2][at] % len(_POINTS)], was))
    labels = np.full(len(points), IGNORED, np.int32)
    labels[at] = text.numbers_of(was)
    offsets = np.concatenate([[0], np.cumsum(size + 2)])
    inner = np.ones(offsets[-1], bool)
    inner[offsets[:-1]] = inner[offsets[1:] - 1] = False

    def lists(values: np.ndarray, begin: int, end: int) -> pa.Array:
        out = np.empty(len(inner), np.int32)
        out[inner], out[offsets[:-1]], out[offsets[1:] - 1] = values, begin, end
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))

    return pa.array(row), [pa.array(part, pa.int32()), lists(points, BEGIN, END), lists(labels, IGNORED, IGNORED)]


def padded(rows: DataFrame, batch: str) -> DataFrame:
    """Sequences of a batch at the length of its longest: padding is not attended to and not guessed."""
    longest = rows.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_longest"))
    out = rows.join(longest, batch)
    for c, fill in (("input_ids", PAD), ("attention_mask", 0), ("labels", IGNORED)):
        out = out.withColumn(c, F.concat(c, F.array_repeat(F.lit(fill), (F.col("_longest") - F.size(c)).cast("int"))))
    return out.drop("_longest")

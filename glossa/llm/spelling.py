"""Spelling variants: words one insertion, deletion or replacement apart, by hashes of what deletions leave.

Two words are that near if one character taken from each at the same place leaves the same string, or one character
taken from the longer leaves the shorter. The hash of a word without its i-th character is put together from the
polynomial hashes of what stands before and after it; NumPy does so for all places of all words of a batch at once, so
a word of m characters costs m integers, not m strings. These keys are dealt by their leading bits and sorted;
neighbours with one key are joined with their words, and only strings that are equal after the deletion count.

Pairs are never listed. Words that agree but for place i are all near each other, and no two words agree so at two
places; what is left of a longer word without one character is one word, the same for each place in a run of equal
characters, of which the first is taken. So a word's near words are counted group by group, and the best of them is
the best of its groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm.common import stored, trimmed

#: Words of at least so many code points and occurrences; a form has FACTOR times the occurrences of its variant.
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: One in NOISE of a document's words loses a character (the query's definition).
NOISE = 31
#: Keys are dealt by their RADIX leading bits. Code points whose keys are made at once; a longer word is on its own.
RADIX, POINTS = 20, 1 << 20
#: An odd number: powers of it, and of its inverse, exist in 64-bit arithmetic.
BASE = 0x9E3779B97F4A7C15
OWN, SHORTER, CHANGED = 0, 1, 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word's number, place): for each word the key of itself (place -1) and of what is left without each of its
    characters: 2 i, and 2 i + 1 if the character before is another one."""
    text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    n = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(n)
    begin = end - n
    up, down = powers(BASE, len(text) + 1), powers(pow(BASE, -1, 1 << 64), len(text) + 1)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    at = np.arange(len(text))
    of = np.repeat(np.arange(len(words)), n)
    a, e = begin[of], end[of]
    left = (before[at] - before[a] + (before[e] - before[at + 1]) * down[min(1, len(text))]) * down[a]
    whole = (before[end] - before[begin]) * down[begin]
    fresh = (at == a) | (text != np.concatenate([text[:1], text[:-1]]))
    key = np.concatenate([whole, left]) + np.concatenate([n, n[of] - 1]).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for shift in (32, 29):
        key = (key ^ key >> np.uint64(shift)) * np.uint64(0x94D049BB133111EB)
    return key ^ key >> np.uint64(32), np.concatenate([np.arange(len(words)), of]), np.concatenate([np.full(len(words), -1), 2 * (at - a) + fresh]).astype(np.int32)


def keyed(words: DataFrame) -> DataFrame:
    """(key, id, at) of all words."""
    points = POINTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            block = np.cumsum([len(t) for t in texts], dtype=np.int64) // points
            cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
            for x, y in zip(cuts, [*cuts, len(texts)][1:], strict=True):
                key, of, at = deletion_keys(texts[x:y])
                whole = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[x:y][of]), pa.array(at)], ["key", "id", "at"])
                yield from (whole.slice(k, 100_000) for k in range(0, whole.num_rows, 100_000))
        trimmed()

    return words.select("id", "word").mapInArrow(run, "key long, id long, at int")


def meeting(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, kind) of the rows that may have a partner, from rows sorted by key and place: a whole word and what is
    left of longer words, and what is left of words without the same place."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    new = np.append(True, key[1:] != key[:-1])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    shorter = (at & 1 == 1) & (at >= 0)
    has_own, has_longer = np.bincount(group, at < 0) > 0, np.bincount(group, shorter, len(start)) > 0
    same = np.append(False, ~new[1:] & (at[1:] >> 1 == at[:-1] >> 1) & (at[1:] >= 0))
    changed = same | np.append(same[1:], False)
    found = [np.flatnonzero((at < 0) & has_longer[group]), np.flatnonzero(shorter & has_own[group]), np.flatnonzero(changed)]
    return np.concatenate(found), np.repeat(np.array([OWN, SHORTER, CHANGED], np.int8), [len(x) for x in found])


def candidates(keys: DataFrame) -> DataFrame:
    """(id, kind, place) of words that meet others under one key. A task holds a batch and the last key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)]

        def sent(cols: list) -> pa.RecordBatch:
            row, kind = meeting(cols[0], cols[2])
            return pa.RecordBatch.from_arrays([pa.array(cols[1][row]), pa.array(kind), pa.array(np.where(kind == OWN, -1, cols[2][row] >> 1).astype(np.int32))], ["id", "kind", "place"])

        for b in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield sent([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield sent(held)
        trimmed()

    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key", "at")
    return dealt.mapInArrow(run, "id long, kind byte, place int")


def without(word: str, place: Column) -> Column:
    """The word without the code point at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def near_counts(words: DataFrame) -> DataFrame:
    """(id, n_near, best): for each word that has near ones their number and the best of them: most occurrences, then
    smallest. Strings are compared here; keys only brought them together."""
    met = candidates(keyed(words)).join(words, "id")
    met = met.withColumn("left", F.when(F.col("kind") == OWN, F.col("word")).otherwise(without("word", F.col("place"))))
    met = met.withColumn("same", F.when(F.col("kind") == CHANGED, F.col("place")).otherwise(-1))
    all_of = W.partitionBy("same", "left")
    ranked = all_of.orderBy(F.col("kind") == OWN, F.desc("n"), "word")
    whole = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("minus"), F.col("word"))
    met = met.select("id", "kind", F.row_number().over(ranked).alias("k"), F.count("*").over(all_of).alias("of"), F.first(one).over(whole).alias("first"), F.nth_value(one, 2).over(whole).alias("second"), F.last(F.when(F.col("kind") == OWN, one)).over(whole).alias("own"))
    near = F.when(F.col("kind") == SHORTER, F.col("own").isNotNull().cast("long")).otherwise(F.col("of") - 1)
    best = F.when(F.col("kind") == SHORTER, F.col("own")).when((F.col("kind") == CHANGED) & (F.col("k") == 1), F.col("second")).otherwise(F.col("first"))
    return met.select("id", near.alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): from the word, forms followed to the last. A form has several times the
    occurrences of its word, so there are no more steps than digits in the largest count."""
    ended, open_ = [], links.select("word", F.col("form").alias("root"))
    further = links.select(F.col("word").alias("root"), F.col("form").alias("further"))
    while True:
        step = stored(open_.join(further, "root", "left"), "roots")
        ended.append(step.where("further IS NULL").select("word", "root"))
        open_ = step.where("further IS NOT NULL").select("word", F.col("further").alias("root"))
        if open_.isEmpty():
            out = ended[0]
            for more in ended[1:]:
                out = out.unionByName(more)
            return out


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of (word, n): near words differ by exactly one inserted, deleted
    or replaced code point. A word's form is its near word of largest n, the smallest in code-point order among equals,
    if that n is at least factor times its own, else null; root follows forms to the last, and is the word if it has
    none.

    Repeated words are added up; rows without a word or a count are left out; words of any length, the empty one
    included, are taken as a whole; an empty table gives an empty result; other columns, whatever their names, are
    ignored.
    """
    if factor < 2:
        raise ValueError("with a factor below 2 words could be each other's form")
    words = words.select("word", "n").where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = stored(words.withColumn("id", F.monotonically_increasing_id()), "spellings")
    best = words.join(near_counts(words), "id", "left")
    is_form = -F.col("best.minus") >= factor * F.col("n")
    table = stored(best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    found = table.join(roots(table.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def noisy_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int | None = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lower-cased. If noise divides the crc32 of `<id>:<run>`, which is then the
    same for all occurrences in a document, the run's character at that crc32 modulo its length is deleted (null: no
    such noise). Words of min_length code points and min_count occurrences remain.

    A null text has no words, a null id is empty; repeated rows count again; texts are taken whole. Runs too short to
    count are not looked at, as a run matches from its first letter to its last.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        word = F.when(h % noise == 0, without("run", (h % F.length("run")).cast("int"))).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(noisy_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
  ) GROUP BY ALL HAVING length(run) >= 7
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)) AS b FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS h FROM bytes, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY ALL HAVING sum(n) >= 2
), less AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL) USING (word)
"""

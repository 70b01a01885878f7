"""Phrases whose words keep company, by contiguous pattern growth over projected occurrences.

Words are counted first. Each occurrence of a frequent word is then a pointer: what stays of it is the words that
follow, as far as a phrase can reach. The pointers of a prefix go to one task, which grows it to the right depth
first: sorted, the pointers that begin with the same longer prefix are neighbours, a prefix with too few of them is
left, and the others are grown again. A batch sends equal pointers once, with their number.

A word that makes up more than a HOT-th of all words would send too much to one task. Its pointers are dealt by
their first two words, and where the second word is as frequent, by all words; counts of prefixes that are spread over
tasks in this way are sums of what the tasks found.

Words are 64-bit hashes on the way, each language with its own; that no two words share one is checked on all words,
and the hashes are drawn anew if it fails.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm.common import stored, trimmed, utf8

#: Phrases of 2 to MAX_WORDS words with MIN_COUNT occurrences; of each language the first TOP.
MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
#: A phrase is dropped inside a longer one with at least so many hundredths of its occurrences.
INSIDE = 50
#: A word above the HOT-th part of all words is hot; there are no more than HOT of them.
HOT = 1000
#: The frequent words are told to the tasks as a field of so many bits, whatever their number: a rare word that is
#: taken for a frequent one costs a pointer and changes no result.
FIELD_BITS = 25
#: Bytes of text in a chunk, and distinct words after which what a task has gathered is sent.
CHUNK_BYTES, STRETCH_WORDS, STRETCH_LENGTH = 2 << 20, 1 << 19, 2_000_000
#: Each language's phrases are ranked in so many shares first.
SHARES = 16
#: Buckets of pointers for each partition; a task holds one bucket at a time.
FINER = 8

#: Fixed by the definition: A-Z are lower-cased, `.,;:!?` and line ends (\\x0A-\\x0D) end a piece, blanks and tabs a word.
#: No byte of UTF-8 is 0xFF, which stands for the end of a piece.
END = b"\xff"
TABLE = bytes(0xFF if c in b".,;:!?\n\v\f\r" else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def chunks(text: bytes, limit: int) -> Iterator[list[bytes]]:
    """The words of a text, with END between pieces and after the last; long texts in chunks, cut at blanks."""
    low = text.translate(TABLE).replace(END, b" \xff ")
    at = 0
    while len(low) - at > limit:
        cut = low.find(b" ", at + limit)
        if cut < 0:
            break
        yield low[at:cut].split()
        at = cut
    yield [*low[at:].split(), END]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hash(lang: str, seed: int):
    of = xxhash.xxh3_64_intdigest(lang.encode(), seed)
    return lambda word: xxhash.xxh3_64_intdigest(word, of)


def lang_and_text(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), utf8(text_col).alias("text"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(id, lang, word, n): all words with their counts; id and word null: the number of a language's words."""
    most_words, chunk = STRETCH_WORDS, CHUNK_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                of, words = word_hash(lang, seed), list(c)
                ids, n = np.fromiter(map(of, words), np.uint64, len(words)).view(np.int64), np.fromiter(c.values(), np.int64, len(words))
                cols = [pa.array([*ids.tolist(), None], pa.int64()), pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.binary()), pa.array([*n.tolist(), int(n.sum())], pa.int64())]
                whole = pa.RecordBatch.from_arrays(cols, ["id", "lang", "word", "n"])
                yield from (whole.slice(k, 20_000) for k in range(0, whole.num_rows, 20_000))
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = counts.setdefault(lang, Counter())
                for words in chunks(text.as_py(), chunk):
                    c.update(words)
                    del c[END]
                    if len(c) > most_words:
                        yield from sent()
                        c = counts.setdefault(lang, Counter())
            if sum(map(len, counts.values())) > most_words:
                yield from sent()
        yield from sent()
        trimmed()

    return docs.mapInArrow(count, "id long, lang string, word binary, n long")


def frequent_words(docs: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, int]:
    """(id, lang, word, n) of the frequent words, (lang, n) of all words, and the seed under which ids are exact."""
    for seed in range(16):
        counts = word_counts(docs, seed).repartition("id").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
        by_id = counts.groupBy("id", F.when(F.col("id").isNull(), F.col("lang")).alias("whole")).agg(F.count("*").alias("words"), F.max("n").alias("most"), F.collect_list(F.struct("lang", "word", "n")).alias("of"))
        kept = stored(by_id.where(F.col("id").isNull() | (F.col("words") > 1) | (F.col("most") >= min_count) | (F.col("id") == 0)), "words")
        if kept.where(F.col("id").isNotNull() & ((F.col("words") > 1) | (F.col("id") == 0))).isEmpty():
            rows = kept.select("id", F.col("of")[0].alias("w"))
            words = rows.where(F.col("id").isNotNull()).select("id", "w.lang", F.col("w.word").cast("string").alias("word"), "w.n")
            return words, rows.where(F.col("id").isNull()).select("w.lang", "w.n"), seed
    raise RuntimeError("two words share their hash under each of 16 seeds")


def field_of(words: DataFrame) -> np.ndarray:
    """A bit for each frequent word, at its hash; FIELD_BITS bits however many words there are."""
    place = F.shiftrightunsigned("id", 64 - FIELD_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    rows = words.select(F.shiftright(place, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << FIELD_BITS - 6, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def in_field(field: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids >> np.uint64(65 - (64 * len(field)).bit_length())
    return field[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0


def hot_words(words: DataFrame, totals: DataFrame) -> np.ndarray:
    """The sorted ids of hot words, at most HOT."""
    total = totals.agg(F.sum("n")).first()[0] or 0
    found = words.where(F.col("n") * HOT > total).select("id").toArrow().column("id").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


class _Index(dict):
    """Words by number, in the order in which they were first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Stretch:
    """A stretch of one language's words as numbers, from which pointers are made."""

    def __init__(self, lang: str, seed: int, max_words: int):
        self.hash, self.k = word_hash(lang, seed), max_words
        self.index = _Index({END: 0})
        self.parts: list[np.ndarray] = []
        self.length = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.length += len(words)

    def pointers(self, field: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pointers, a row of word hashes each, and their numbers; 0 is the end of a piece or a rare word.
        The last words of a stretch that goes on stay, as what follows them is not known yet."""
        names = list(self.index)
        ids = np.fromiter(map(self.hash, names), np.uint64, len(names))
        ids[0] = 0
        keep = in_field(field, ids)
        keep[0] = False
        ids = ids[keep]
        dense = np.where(keep, np.cumsum(keep), 0)
        seq = np.concatenate([*self.parts, np.zeros(self.k if last else 0, np.int32)])
        n = max(0, len(seq) - self.k + 1)
        left = seq[n:]
        seq = dense[seq]
        first = seq[:n]
        at = np.flatnonzero((first > 0) & (seq[1 : n + 1] > 0)) if n else np.zeros(0, np.int64)
        bits = max(1, int(len(ids)).bit_length())
        if bits * self.k > 63:
            raise ValueError("a stretch has too many words for phrases of this length")
        key, open_ = seq[at].astype(np.int64), np.ones(len(at), bool)
        for j in range(1, self.k):
            nxt = seq[at + j]
            open_ &= nxt > 0
            key = key << bits | np.where(open_, nxt, 0)
        key, many = np.unique(key, return_counts=True)
        ids = np.concatenate([np.zeros(1, np.uint64), ids])
        rows = np.stack([ids[key >> bits * (self.k - 1 - j) & (1 << bits) - 1] for j in range(self.k)])
        self.index, self.parts, self.length = _Index({END: 0}), [], 0
        self.add([names[i] for i in left.tolist()])
        return rows, many


def dealt_by(rows: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pointer: by its first word; if that is hot by the first two, if both are by all."""
    is_hot = lambda w: np.isin(w, hot, kind="sort")
    unit, split = mixed(rows[0]), is_hot(rows[0])
    for j in range(1, len(rows)):
        unit = np.where(split, mixed(unit ^ rows[j]), unit)
        split &= is_hot(rows[j])
    return (mixed(unit + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)


def grown(rows: np.ndarray, many: np.ndarray, hot: np.ndarray, min_count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, counts) of each length from 2 on, from all pointers of a bucket. A phrase whose words are all hot may
    have pointers elsewhere, unless it is as long as a pointer: it comes out whatever its count."""
    order = np.lexsort(rows[::-1])
    rows, many = rows[:, order], many[order]
    split = np.isin(rows[0], hot, kind="sort")
    fresh = np.append(True, rows[0, 1:] != rows[0, :-1])[: rows.shape[1]]
    for j in range(1, len(rows)):
        split = split & np.isin(rows[j], hot, kind="sort") if j < len(rows) - 1 else np.zeros(rows.shape[1], bool)
        fresh[1:] |= rows[j, 1:] != rows[j, :-1]
        begin = np.flatnonzero(fresh)
        if not len(begin):
            return
        total = np.add.reduceat(many, begin)
        alive = (rows[j, begin] > 0) & ((total >= min_count) | split[begin])
        yield rows[: j + 1, begin[alive]], total[alive]
        stay = np.repeat(alive, np.diff(np.append(begin, rows.shape[1])))
        rows, many, split, fresh = rows[:, stay], many[stay], split[stay], fresh[stay]


def phrases(docs: DataFrame, words: DataFrame, totals: DataFrame, seed: int, max_words: int, min_count: int) -> DataFrame:
    """(w1, .., wk, a): every phrase of 2 to k frequent words with its count, from min_count on; absent words are 0."""
    spark = docs.sparkSession
    tell = spark.sparkContext.broadcast((field_of(words), hot_words(words, totals)))
    buckets = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"w{j}" for j in range(1, max_words + 1)]
    most_words, most_length, chunk = STRETCH_WORDS, STRETCH_LENGTH, CHUNK_BYTES

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, hot = tell.value
        stretches: dict[str, Stretch] = {}

        def sent(s: Stretch, last: bool) -> Iterator[pa.RecordBatch]:
            rows, many = s.pointers(field, last)
            if not len(many):
                return
            to = dealt_by(rows, hot, buckets)
            order = np.argsort(to, kind="stable")
            to, rows, many = to[order], rows[:, order], many[order].astype(np.uint32)
            cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
            for k in range(0, len(cuts), 256):
                ends = [*cuts, len(to)][k : k + 257]
                blobs = [rows[:, a:b].tobytes() + many[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(to[ends[: len(blobs)]]), pa.array(blobs, pa.binary())], ["bucket", "pointers"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lang not in stretches:
                    stretches[lang] = Stretch(lang, seed, max_words)
                s = stretches[lang]
                for part in chunks(text.as_py(), chunk):
                    s.add(part)
                    if len(s.index) > most_words or s.length > most_length:
                        yield from sent(s, False)
            if sum(s.length for s in stretches.values()) > most_length:
                for s in stretches.values():
                    yield from sent(s, True)
                stretches.clear()
        for s in stretches.values():
            yield from sent(s, True)
        stretches.clear()
        trimmed()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = tell.value[1]

        def one(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            of = [len(x) // (8 * max_words + 4) for x in blobs]
            rows = np.concatenate([np.frombuffer(x, np.uint64, n * max_words).reshape(max_words, n) for x, n in zip(blobs, of, strict=True)], axis=1)
            many = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * max_words * n) for x, n in zip(blobs, of, strict=True)]).astype(np.int64)
            for found, total in grown(rows, many, hot, min_count):
                cols = [found[j].view(np.int64) if j < len(found) else np.zeros(len(total), np.int64) for j in range(max_words)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(total)], [*names, "a"])

        at, held = None, []
        for b in batches:
            for bucket, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if bucket != at and held:
                    yield from one(held)
                    held = []
                at = bucket
                held.append(x.as_py())
        if held:
            yield from one(held)
        trimmed()

    sent = docs.mapInArrow(project, "bucket int, pointers binary").repartition("bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(grow, ", ".join(f"{n} long" for n in names) + ", a long")
    return found.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int | None = TOP, inside: int = INSIDE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to max_words words by how much more often
    they occur than their parts. a is a phrase's count; it is cut where floor(1000000 a a / (l r)) is least, first cut
    among equals, l and r being the counts of the parts; n counts the language's words. Phrases inside longer ones with
    at least `inside` hundredths of their count are left out. top=None returns all.

    A null text has no words, a null language is `und`; repeated rows count again; ties are broken by count and by the
    phrase's bytes; texts of any length count as a whole; no phrase crosses a row; an empty table gives an empty result;
    other columns, whatever their names, are ignored. Counts are exact: products are decimals, of counts below 10^12.
    """
    if not 2 <= max_words <= 3:
        raise ValueError("phrases of 2 or 3 words only: a pointer's words must fit in 63 bits")
    if not 0 <= inside <= 100 or min_count < 1:
        raise ValueError("inside is in hundredths, min_count at least 1")
    docs = lang_and_text(docs, text_col, lang_col)
    words, totals, seed = frequent_words(docs, min_count)
    found = stored(phrases(docs, words, totals, seed, max_words, min_count), "phrases")
    names = [f"w{j}" for j in range(1, max_words + 1)]

    def of_length(k: int) -> DataFrame:
        shorter = F.col(names[k - 1]) != 0
        return found.where(shorter & (F.col(names[k]) == 0) if k < max_words else shorter)

    def counted(df: DataFrame, of: list[str], n: str) -> DataFrame:
        """df with the count of the part that these columns spell."""
        counts = words.select("id", "n") if len(of) == 1 else of_length(len(of)).select(*names[: len(of)], "a")
        return df.join(counts.toDF(*of, n), of)

    tables = []
    for k in range(2, max_words + 1):
        df, cuts = of_length(k), []
        for c in range(1, k):
            df = counted(counted(df, names[:c], f"l{c}"), names[c:k], f"r{c}")
            big = lambda x: F.col(x).cast("decimal(12,0)")
            df = df.withColumn(f"s{c}", F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * big("a") * big("a"), big(f"l{c}") * big(f"r{c}")))
            cuts.append(F.struct(F.col(f"s{c}").alias("score"), F.lit(c).alias("k"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        tables.append(df.select(*names, "a", best.alias("best")))
    scored = tables[0]
    for longer in tables[1:]:
        scored = scored.unionByName(longer)

    if max_words > 2:  # the most frequent longer phrase that a phrase lies in
        around = [found.where(F.col("w3") != 0).select(F.col(a).alias("w1"), F.col(b).alias("w2"), F.lit(0).cast("long").alias("w3"), F.col("a").alias("longer")) for a, b in (("w1", "w2"), ("w2", "w3"))]
        around = around[0].unionByName(around[1]).groupBy(*names).agg(F.max("longer").alias("longer"))
        scored = scored.join(around, names, "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))

    spelled = words.select("id", "lang", "word")
    for j, w in enumerate(names):
        here = spelled.select(F.col("id").alias(w), F.col("word").alias(f"s_{w}"), *([F.col("lang")] if not j else []))
        scored = scored.join(here, w, "inner" if j < 2 else "left")
    rows = scored.select("lang", F.concat_ws(" ", *[f"s_{w}" for w in names]).alias("phrase"), "a", "best.l", "best.r", "best.score")
    first = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    if top is not None:  # the first of each share come together, so what one task ranks does not grow with the corpus
        rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("k", first("share")).where(F.col("k") <= top)
    ranked = rows.withColumn("rank", first())
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals.select("lang", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents WHERE text IS NOT NULL)
), words AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces WHERE len(ws) > 0
), uni AS (SELECT lang, ws[i] AS w1, count(*) AS f FROM words GROUP BY ALL
), total AS (SELECT lang, count(*) AS n FROM words GROUP BY ALL
), bi AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM words WHERE i + 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 10
), tri AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM words WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM bi b JOIN uni x ON x.lang = b.lang AND x.w1 = b.w1 JOIN uni y ON y.lang = b.lang AND y.w1 = b.w2
  WHERE NOT EXISTS (SELECT 1 FROM tri t WHERE t.lang = b.lang AND t.w1 = b.w1 AND t.w2 = b.w2 AND 100 * t.f >= 50 * b.f)
    AND NOT EXISTS (SELECT 1 FROM tri t WHERE t.lang = b.lang AND t.w2 = b.w1 AND t.w3 = b.w2 AND 100 * t.f >= 50 * b.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
  FROM tri t JOIN uni x ON x.lang = t.lang AND x.w1 = t.w1 JOIN bi y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
  FROM tri t JOIN bi x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN uni y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (
  SELECT *, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

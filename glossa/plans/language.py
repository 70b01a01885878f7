"""Queries of TF-IDF, embedding models, lexicostatistics and translation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.functions import text
from glossa.operators import embedding as EM
from glossa.operators import pieces as P
from glossa.operators import relational as R
from glossa.operators import scoring as SC
from glossa.operators import statistics as S
from glossa.operators import tfidf as T
from glossa.operators import translation as MT
from glossa.plans.base import BLANK, H32, rounded, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BENCH = "doc AS (SELECT conv_id * 100 + turn AS id, turn % 5 AS code, lower(text) AS t FROM conversations)"


def _texts(spark, sf):
    """Short texts in five groups, whole."""
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("turn") % 5).alias("code"), F.lower("text").alias("t"))


TF_WORD = f"""{BENCH}, w AS (SELECT id, code, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]{{2,}}') AS w FROM doc),
g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL)"""
WEIGHTS = """nd AS (SELECT count(DISTINCT id) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), nd),
wt AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x)"""


def _word_weights(spark, sf):
    tf = T.term_counts(_texts(spark, sf), ["id"], T.word_ngrams(F.col("t")))
    return T.weights(tf, tf, ["id"])


@query(f"WITH {TF_WORD}, {WEIGHTS} SELECT id, term, round(w, 6) AS w FROM wt")
def emb1_word_tfidf(spark, sf):
    return _word_weights(spark, sf).select("id", "term", F.round("w", 6).alias("w"))


@query(f"""WITH {BENCH}, p AS (SELECT id, ' ' || w || ' ' AS p FROM (SELECT id, unnest(regexp_split_to_array(t, '{BLANK}+')) AS w FROM doc) WHERE w <> ''),
g AS (SELECT id, substr(p, i, n) AS term FROM (SELECT id, p, n, unnest(range(1, greatest(length(p) - n + 1, 1) + 1)) AS i FROM p, (SELECT unnest([3, 4, 5]) AS n) WHERE n = 3 OR length(p) >= n)), tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL),
{WEIGHTS} SELECT id, term, round(w, 6) AS w FROM wt""")
def emb2_char_tfidf(spark, sf):
    tf = T.term_counts(_texts(spark, sf), ["id"], T.char_ngrams(F.col("t")))
    return T.weights(tf, tf, ["id"]).select("id", "term", F.round("w", 6).alias("w"))


CENT = "sz AS (SELECT code, count(DISTINCT id) AS n FROM doc JOIN (SELECT DISTINCT id FROM wt) USING (id) GROUP BY code), ce AS (SELECT code, term, sum(w) / any_value(n) AS w FROM wt JOIN doc USING (id) JOIN sz USING (code) GROUP BY code, term)"


def _centroids(spark, sf):
    w = _word_weights(spark, sf).join(_texts(spark, sf).select("id", "code").distinct().hint("merge"), "id")
    sizes = w.groupBy("code").agg(F.count_distinct("id").alias("n"))
    return T.sparse_centroids(w, ["code"], sizes)


@query(f"WITH {TF_WORD}, {WEIGHTS}, {CENT}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(w, 9) DESC, term) AS rank FROM ce WHERE w > 0) SELECT code, rank::INTEGER AS rank, term, round(w, 6) AS w FROM r WHERE rank <= 5")
def top3_top_features(spark, sf):
    c = _centroids(spark, sf).withColumn("w", F.round("w", 9))
    return T.top_terms(c, "code", 5).select("code", "rank", "term", rounded("w").alias("w"))


@query(f"WITH {TF_WORD}, {WEIGHTS}, {CENT}, ln AS (SELECT code, sqrt(sum(w * w)) AS l FROM ce GROUP BY code) SELECT x.code AS a, y.code AS b, round(greatest(0, 1 - sum(x.w * y.w) / any_value(p.l * q.l)), 6) AS d FROM ce x JOIN ce y ON x.term = y.term AND x.code < y.code JOIN ln p ON p.code = x.code JOIN ln q ON q.code = y.code GROUP BY ALL")
def st6_sparse_distances(spark, sf):
    return T.sparse_cosines(_centroids(spark, sf), "code").select("a", "b", rounded("d").alias("d"))


@query(f"""WITH {TF_WORD}, {WEIGHTS}, rw AS (SELECT id, code, row_number() OVER (PARTITION BY code ORDER BY id) - 1 AS idx, count(*) OVER (PARTITION BY code) AS n FROM (SELECT DISTINCT id, code FROM doc)),
k AS (SELECT code, n, unnest(range(n)) AS k FROM (SELECT DISTINCT code, n FROM rw)), t2 AS (SELECT *, unnest(range(3)) AS b FROM k), m AS (SELECT code, b, {H32.format("'21-' || b || '-' || code || '-' || k")} % n AS idx, count(*) AS mult FROM t2 GROUP BY ALL),
s AS (SELECT m.b, m.code, term, sum(mult * w) / any_value(n) AS w FROM m JOIN rw USING (code, idx) JOIN wt USING (id) GROUP BY ALL) SELECT b::INTEGER AS b, code, count(*)::BIGINT AS n_terms, round(sqrt(sum(w * w)), 6) AS len FROM s GROUP BY ALL""")
def vec6_resampled_centroids(spark, sf):
    rows = _texts(spark, sf).select("id", "code").distinct().withColumn("idx", (F.row_number().over(Window.partitionBy("code").orderBy("id")) - 1).cast("long"))
    sizes = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    drawn = R.draws(sizes, ["code"], "n", 3, "21").join(rows, ["code", "idx"])
    c = T.sparse_centroids(drawn.join(_word_weights(spark, sf), "id"), ["b", "code"], sizes, "mult")
    return c.groupBy("b", "code").agg(F.count(F.lit(1)).alias("n_terms"), rounded(F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("len"))


@query()
def emb3_subword_vectors(spark, sf):
    docs = _texts(spark, sf)
    words = EM.word_model(docs, "t", 16).getVectors()
    from pyspark.ml.functions import vector_to_array

    table_ = EM.subword_table(words.select("word", vector_to_array("vector").alias("vec")), 16)
    tokens = docs.select("code", F.explode(text.letter_tokens("t")).alias("word")).distinct()
    met = tokens.select("code", F.explode(EM.subwords(F.col("word"), (3, 4, 5, 6), 1 << 16)).alias("bucket")).join(table_.hint("merge"), "bucket")
    from glossa.functions import vectors as V

    return met.groupBy("code").agg(V.mean_of("vec", 16).alias("vec")).select("code", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query()
def emb4_word2vec(spark, sf):
    from pyspark.ml.functions import vector_to_array

    docs = _texts(spark, sf)
    vectors = EM.word_model(docs, "t", 16).getVectors().select("word", vector_to_array("vector").alias("vec"))
    return EM.pooled(docs, ["id"], "t", vectors, 16, zero_fill=True).select("id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query()
def emb5_bpe_merges(spark, sf):
    words = _texts(spark, sf).select(F.explode(text.letter_tokens("t")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(P.learned(words, 8))], "step int, left string, right string")


@query()
def emb6_hashing_encoder(spark, sf):
    v = EM.encode(_texts(spark, sf), ["id"], "t", EM.HashingEncoder)
    return v.select("id", F.round(F.col("vec")[0], 6).alias("x1"), F.size("vec").alias("dims"))


WORDS = """tk AS (SELECT lang AS code, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents), ct AS (SELECT code, w, count(*) AS n FROM tk WHERE length(w) > 2 GROUP BY ALL),
fm AS (SELECT code, w AS form, row_number() OVER (PARTITION BY code ORDER BY n DESC, w) AS concept FROM ct QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, w) <= 40)"""


def _wordlist(spark, sf):
    """The most frequent words of each language as forms of numbered concepts."""
    w = table(spark, sf, "documents").select(F.col("lang").alias("code"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("form"))
    n = w.where(F.length("form") > 2).groupBy("code", "form").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("concept", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "form"))).where("concept <= 40").select("code", "concept", "form")


def _form_pairs(forms):
    """(a, b, i, j, d): distances of all forms of two languages over the concepts that both have."""
    shared = forms.alias("x").join(forms.alias("y"), (F.col("x.concept") == F.col("y.concept")) & (F.col("x.code") < F.col("y.code")))
    both = shared.select(F.col("x.code").alias("a"), F.col("y.code").alias("b"), F.col("x.concept").alias("i"), F.col("x.form").alias("fa"), F.col("y.form").alias("fb"))
    left, right = both.select("a", "b", "i", "fa"), both.select("a", "b", F.col("i").alias("j"), "fb")
    return left.join(right, ["a", "b"]).select("a", "b", "i", "j", text.edit_distance("fa", "fb").alias("d"))  # concepts squared, a wordlist's size


def _lev(a: str, b: str) -> str:
    """SQL: edit distance in characters. Its function counts bytes, so each accented letter becomes one ASCII sign that
    lower-case words do not hold."""
    one = lambda c: f"translate({c}, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ012345')"
    return f"levenshtein({one(a)}, {one(b)})::DOUBLE / greatest(length({a}), length({b}))"


NLEV = _lev("x.form", "y.form")


@query(f"WITH {WORDS} SELECT x.code AS a, y.code AS b, round(avg({NLEV}), 6) AS ld, count(*)::BIGINT AS n FROM fm x JOIN fm y ON x.concept = y.concept AND x.code < y.code GROUP BY ALL HAVING count(*) >= 5")
def st15_txt19_mean_edit_distance(spark, sf):
    f = _wordlist(spark, sf)
    x, y = f.withColumnsRenamed({"code": "a", "form": "fa"}), f.withColumnsRenamed({"code": "b", "form": "fb"})
    p = x.join(y, "concept").where("a < b").groupBy("a", "b").agg(rounded(F.avg(text.edit_distance("fa", "fb"))).alias("ld"), F.count(F.lit(1)).alias("n"))
    return p.where("n >= 5")


FP = f"{WORDS}, sh AS (SELECT x.code AS a, y.code AS b, x.concept AS i, x.form AS fa, y.form AS fb FROM fm x JOIN fm y ON x.concept = y.concept AND x.code < y.code), fp AS (SELECT x.a, x.b, x.i, y.i AS j, {_lev("x.fa", "y.fb")} AS d FROM sh x JOIN sh y USING (a, b))"


@query(f"WITH {FP} SELECT a, b, round(CASE WHEN avg(d) FILTER (i <> j) > 0 THEN avg(d) FILTER (i = j) / avg(d) FILTER (i <> j) ELSE avg(d) FILTER (i = j) END, 6) AS ldnd FROM fp GROUP BY ALL")
def st16_ldnd(spark, sf):
    p = _form_pairs(_wordlist(spark, sf))
    same, other = F.avg(F.when(F.col("i") == F.col("j"), F.col("d"))), F.avg(F.when(F.col("i") != F.col("j"), F.col("d")))
    return p.groupBy("a", "b").agg(rounded(F.when(other > 0, same / other).otherwise(same)).alias("ldnd"))


LD_DRAWS = 1000
#: Intervals of both distances: concepts are drawn from the whole list, a pair keeps those that it shares.
LD_CI = f"""{FP}, it AS (SELECT unnest(range({LD_DRAWS})) AS b), cn AS (SELECT max(concept) AS n FROM fm), k AS (SELECT b AS it, n, unnest(range(n)) AS k FROM it, cn), m AS (SELECT it, {H32.format("'31-' || it || '-w-' || k")} % n + 1 AS c, count(*) AS mult FROM k GROUP BY ALL),
s AS (SELECT p.it, a, b, sum(p.mult * q.mult * d) AS every, sum(p.mult * d) FILTER (i = j) AS same, sum(p.mult) FILTER (i = j) AS n FROM fp JOIN m p ON p.c = fp.i JOIN m q ON q.c = fp.j AND q.it = p.it GROUP BY ALL),
e AS (SELECT a, b, it, same / n AS ld, CASE WHEN n > 1 THEN (every - same) / (n * n - n) END AS other FROM s), r AS (SELECT a, b, ld, CASE WHEN other > 1e-12 THEN ld / other ELSE ld END AS ldnd FROM e),
iv AS (SELECT a, b, quantile_cont(ld, 0.025) AS ld_lo, quantile_cont(ld, 0.975) AS ld_hi, quantile_cont(ldnd, 0.025) AS lo, quantile_cont(ldnd, 0.975) AS hi FROM r GROUP BY ALL)"""


@query(f"WITH {LD_CI} SELECT a, b, round(ld_lo, 5) AS ld_lo, round(ld_hi, 5) AS ld_hi, round(lo, 5) AS lo, round(hi, 5) AS hi FROM iv")
def st17_ldnd_bootstrap(spark, sf):
    f = _wordlist(spark, sf)
    ci = S.distance_intervals(_form_pairs(f), f.agg(F.lit("w").alias("code"), F.max("concept").alias("n")), LD_DRAWS, "31")
    return ci.select("a", "b", *[F.round(c, 5).alias(c) for c in ("ld_lo", "ld_hi", "lo", "hi")])


@query(f"WITH {LD_CI}, pt AS (SELECT a, b, CASE WHEN avg(d) FILTER (i <> j) > 0 THEN avg(d) FILTER (i = j) / avg(d) FILTER (i <> j) ELSE avg(d) FILTER (i = j) END AS m FROM fp GROUP BY ALL) SELECT a, b, printf('%.3f [%.3f,%.3f]', m, lo, hi) AS cell FROM pt JOIN iv USING (a, b)")
def snk11_interval_cells(spark, sf):
    f = _wordlist(spark, sf)
    p = _form_pairs(f)
    same, other = F.avg(F.when(F.col("i") == F.col("j"), F.col("d"))), F.avg(F.when(F.col("i") != F.col("j"), F.col("d")))
    point = p.groupBy("a", "b").agg(F.when(other > 0, same / other).otherwise(same).alias("m"))
    ci = S.distance_intervals(p, f.agg(F.lit("w").alias("code"), F.max("concept").alias("n")), LD_DRAWS, "31")
    return point.join(ci, ["a", "b"]).select("a", "b", F.format_string("%.3f [%.3f,%.3f]", "m", "lo", "hi").alias("cell"))


MTSQL = """cv AS (SELECT 'd' || conv_id % 3 AS target, conv_id * 2 + turn // 4 AS unit, turn % 4 AS k, text FROM conversations),
gold AS (SELECT target, unit, row_number() OVER (PARTITION BY target ORDER BY unit) - 1 AS pos, text AS ref FROM cv WHERE k = 0),
preds AS (SELECT target, 's' || k AS source, pos, text AS pred FROM cv JOIN gold USING (target, unit) WHERE k > 0),
mt AS (SELECT source || '-' || target || '-' || pos AS id, source, target, pos, trim(ref) AS ref, trim(pred) AS pred FROM preds JOIN gold USING (target, pos) WHERE trim(ref) <> '' AND trim(pred) <> '')"""


def _files(spark, sf):
    """Conversations as translations: of every four turns the first is the reference, the others three systems' text;
    missing turns are missing predictions."""
    cv = table(spark, sf, "conversations").select(F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")).alias("target"), (F.col("conv_id") * 2 + F.floor(F.col("turn") / 4)).alias("unit"), (F.col("turn") % 4).alias("k"), "text")
    gold = cv.where("k = 0").select("target", "unit", (F.row_number().over(Window.partitionBy("target").orderBy("unit")) - 1).cast("long").alias("pos"), F.col("text").alias("ref"))  # a test set's sentences
    preds = cv.where("k > 0").join(gold.select("target", "unit", "pos"), ["target", "unit"]).select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("source"), "target", "pos", F.col("text").alias("pred"))
    return preds, gold.select("target", "pos", "ref")


def _translations(spark, sf):
    """(id, source, target, pos, pred, ref): whole texts, as they are."""
    return SC.scored_pairs(*_files(spark, sf), "truncate").withColumn("id", F.concat_ws("-", "source", "target", "pos"))


MATCH = "ms AS (SELECT id, source, target, pos, kind, sum(coalesce(h, 0)) AS hyp, sum(coalesce(r, 0)) AS ref, sum(least(coalesce(h, 0), coalesce(r, 0))) AS match FROM (SELECT id, source, target, pos, kind, gram, count(*) AS h FROM gh GROUP BY ALL) FULL JOIN (SELECT id, source, target, pos, kind, gram, count(*) AS r FROM gr GROUP BY ALL) USING (id, source, target, pos, kind, gram) GROUP BY ALL)"
PUNCT = "list_contains(string_split('!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(39), ''), {0})"
KEYS = "id, source, target, pos"


def _chrf_grams(side: str, rows: str = "mt") -> str:
    words = f"flatten(list_transform(list_filter(regexp_split_to_array({side}, '{BLANK}+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 1 AND {PUNCT.replace('{0}', 'right(w, 1)')} THEN [left(w, length(w) - 1), right(w, 1)] WHEN length(w) > 1 AND {PUNCT.replace('{0}', 'left(w, 1)')} THEN [left(w, 1), substr(w, 2)] ELSE [w] END))"
    return f"""SELECT {KEYS}, 'c' || n AS kind, substr(s, i, n) AS gram FROM (SELECT {KEYS}, n, s, unnest(range(1, length(s) - n + 2)) AS i FROM (SELECT {KEYS}, regexp_replace({side}, '{BLANK}+', '', 'g') AS s FROM {rows}), (SELECT unnest(range(1, 7)) AS n))
UNION ALL SELECT {KEYS}, 'w' || n, array_to_string(w[i : i + n - 1], ' ') FROM (SELECT {KEYS}, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT {KEYS}, {words} AS w FROM {rows}), (SELECT unnest(range(1, 3)) AS n))"""


def _chrf_sql(by: str, rows: str = "ms") -> str:
    """(by, score) of a table of statistics."""
    return f"SELECT {by}, coalesce(500 * avg(p) * avg(r) / nullif(4 * avg(p) + avg(r), 0), 0) AS score FROM (SELECT {by}, kind, sum(match) / sum(hyp) AS p, sum(match) / sum(ref) AS r FROM {rows} GROUP BY ALL HAVING sum(hyp) > 0 AND sum(ref) > 0) GROUP BY {by}"


CHRF = f"gh AS ({_chrf_grams('pred')}), gr AS ({_chrf_grams('ref')}), {MATCH}"


@query(f"WITH {MTSQL}, {CHRF} SELECT source, target, round(score, 4) AS chrf FROM ({_chrf_sql('source, target')})")
def mt1_chrf(spark, sf):
    stats = MT.match_statistics(_translations(spark, sf), ["source", "target"], "chrfpp")
    return MT.chrf(stats, ["source", "target"]).select("source", "target", rounded("chrf", 4).alias("chrf"))


def _bleu_grams(side: str) -> str:
    x = f"replace(replace(replace(replace(replace(replace(replace({side}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    x = f"regexp_replace(' ' || {x} || ' ', '([\\{{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])', ' \\1 ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g'), '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    x = f"list_filter(regexp_split_to_array(regexp_replace({x}, '([0-9])(-)', '\\1 \\2 ', 'g'), '{BLANK}+'), lambda w: w <> '')"
    return f"SELECT {KEYS}, 'b' || n AS kind, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT {KEYS}, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT {KEYS}, {x} AS w FROM mt), (SELECT unnest(range(1, 5)) AS n))"


BLEU = """tb AS (SELECT source, target, kind, sum(hyp) AS h, sum(ref) AS r, sum(match) AS m FROM ms GROUP BY ALL),
ord AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, target ORDER BY kind) AS misses FROM tb),
sc AS (SELECT source, target, sum(CASE WHEN m > 0 THEN ln(m / h) ELSE -ln(pow(2, misses) * h) END) AS lg, max(CASE WHEN kind = 'b1' THEN h END) AS h1, max(CASE WHEN kind = 'b1' THEN r END) AS r1, max(CASE WHEN kind = 'b1' THEN m END) AS m1, max(CASE WHEN kind = 'b4' THEN h END) AS h4 FROM ord GROUP BY ALL),
bl AS (SELECT source, target, CASE WHEN h4 > 0 AND m1 > 0 THEN 100 * (CASE WHEN h1 < r1 THEN exp(1 - r1 / h1) ELSE 1 END) * exp(lg / 4) ELSE 0 END AS bleu FROM sc)"""
BLEU_GRAMS = f"gh AS ({_bleu_grams('pred')}), gr AS ({_bleu_grams('ref')}), {MATCH}"


@query(f"WITH {MTSQL}, {BLEU_GRAMS}, {BLEU} SELECT source, target, round(bleu, 4) AS bleu FROM bl")
def mt2_bleu(spark, sf):
    stats = MT.match_statistics(_translations(spark, sf), ["source", "target"], "bleu")
    return MT.bleu(stats, ["source", "target"]).select("source", "target", rounded("bleu", 4).alias("bleu"))


@query(f"WITH {MTSQL}, {BLEU_GRAMS} SELECT id, kind, hyp::BIGINT AS hyp, ref::BIGINT AS ref, match::BIGINT AS match FROM ms")
def mt3_sufficient_statistics(spark, sf):
    stats = MT.match_statistics(_translations(spark, sf), ["id"], "bleu")
    return stats.where("hyp + ref > 0")


@query(f"""WITH {MTSQL}, {CHRF}, cs AS ({_chrf_sql('source, target')}), n AS (SELECT source, target, count(*) AS n FROM mt GROUP BY ALL)
SELECT source, target, n::BIGINT AS n_sentences, round(score, 4) AS chrfpp, round(bleu, 4) AS bleu FROM n JOIN cs USING (source, target) JOIN (WITH {BLEU_GRAMS}, {BLEU} SELECT * FROM bl) USING (source, target)""")
def mt5_score_files(spark, sf):
    return SC.score_files(*_files(spark, sf), "truncate")


@query()
def mt4_greedy_match(spark, sf):
    m = MT.token_scores(_translations(spark, sf), ["source", "target", "pos"], EM.HashingEncoder)
    return m.select("source", "target", "pos", *[F.round(c, 5).alias(c) for c in ("precision", "recall", "f1")])


BOOT, ALPHA = 1000, 0.05
#: Resamples of systems' statistics ms2 (grp, system, pos, kind, ..) over the positions sel (grp, pos), and the test.
TESTED = f"""ix AS (SELECT grp, pos, row_number() OVER (PARTITION BY grp ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM sel), sz AS (SELECT DISTINCT grp, n FROM ix WHERE n >= 5),
k AS (SELECT grp, n, unnest(range(n)) AS k FROM sz), t AS (SELECT *, unnest(range({BOOT})) AS b FROM k), dr AS (SELECT grp, b, {H32.format("'77-' || b || '-' || grp || '-' || k")} % n AS idx, count(*) AS mult FROM t GROUP BY ALL UNION ALL SELECT grp, -1, idx, 1 FROM ix WHERE n >= 5),
wt AS (SELECT grp, system, b, kind, mult * hyp AS hyp, mult * ref AS ref, mult * match AS match FROM dr JOIN ix USING (grp, idx) JOIN ms2 USING (grp, pos)), so AS ({_chrf_sql('grp, system, b', 'wt')}),
pq AS (SELECT grp, b, x.system AS sa, y.system AS sb, x.score AS xa, y.score AS xb, x.score - y.score AS d FROM so x JOIN so y USING (grp, b) WHERE x.system < y.system),
o AS (SELECT grp, sa, sb, xa, xb, d AS delta FROM pq WHERE b = -1),
pv AS (SELECT grp, sa, sb, any_value(xa) AS score_a, any_value(xb) AS score_b, any_value(delta) AS delta, quantile_cont(x.d, 0.025) AS lo, quantile_cont(x.d, 0.975) AS hi, least(2 * CASE WHEN any_value(delta) > 0 THEN avg((x.d <= 0)::INTEGER) WHEN any_value(delta) < 0 THEN avg((x.d >= 0)::INTEGER) ELSE 0.5 END, 1) AS p FROM (SELECT grp, sa, sb, d FROM pq WHERE b >= 0) x JOIN o USING (grp, sa, sb) GROUP BY ALL)"""


@query(f"""WITH {MTSQL}, {CHRF}, nn AS (SELECT target, count(DISTINCT source) AS want FROM preds GROUP BY target), le AS (SELECT target, min(m) AS n FROM (SELECT target, source, max(pos) + 1 AS m FROM preds GROUP BY ALL UNION ALL SELECT target, '', max(pos) + 1 FROM gold GROUP BY ALL) GROUP BY target),
sel AS (SELECT target AS grp, pos FROM mt JOIN nn USING (target) JOIN le USING (target) WHERE pos < n GROUP BY target, pos HAVING count(DISTINCT source) = any_value(want)), ms2 AS (SELECT target AS grp, source AS system, pos, kind, hyp, ref, match FROM ms), {TESTED}
SELECT grp AS target, sa AS source_a, sb AS source_b, 'chrfpp' AS metric, sz.n::BIGINT AS n_sentences, round(score_a, 4) AS score_a, round(score_b, 4) AS score_b, round(delta, 4) AS delta, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high, round(p, 6) AS p_value, round(least(p * count(*) OVER (PARTITION BY grp), 1), 6) AS p_value_bonferroni, p < {ALPHA} AS significant_alpha, least(p * count(*) OVER (PARTITION BY grp), 1) < {ALPHA} AS significant_bonf FROM pv JOIN sz USING (grp)""")
def st18_20_within_system(spark, sf):
    r = SC.within_system(*_files(spark, sf), ["chrfpp"], BOOT, "77", "truncate", ALPHA)
    return r.select("target", "source_a", "source_b", "metric", "n_sentences", *[rounded(a, 4).alias(b) for a, b in (("score_a", "score_a"), ("score_b", "score_b"), ("delta", "delta"), ("lo", "ci_low"), ("hi", "ci_high"))], rounded("p").alias("p_value"), rounded("p_bonferroni").alias("p_value_bonferroni"), "significant_alpha", "significant_bonf")


def _systems(spark, sf):
    preds, gold = _files(spark, sf)
    return {"A": preds, "B": preds.withColumn("pred", F.translate("pred", "aei", "eio"))}, gold


CROSS = f"""mt2 AS (SELECT 'A' AS system, * FROM mt UNION ALL SELECT 'B', id, source, target, pos, ref, translate(pred, 'aei', 'eio') FROM mt), mx AS (SELECT system || '/' || id AS id, source, target, pos, ref, pred FROM mt2),
gh AS ({_chrf_grams('pred', 'mx')}), gr AS ({_chrf_grams('ref', 'mx')}), {MATCH}, ms2 AS (SELECT source || '-' || target AS grp, left(id, 1) AS system, pos, kind, hyp, ref, match FROM ms), sel AS (SELECT DISTINCT source || '-' || target AS grp, pos FROM mt), {TESTED},
xs AS (SELECT split_part(grp, '-', 1) AS source, split_part(grp, '-', 2) AS target, sa AS system_a, sb AS system_b, sz.n::BIGINT AS n_sentences, round(score_a, 4) AS score_a, round(score_b, 4) AS score_b, delta, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high, p, least(p * count(*) OVER (), 1) AS pb FROM pv JOIN sz USING (grp))"""


def _cross(spark, sf):
    return SC.cross_system(*_systems(spark, sf), ["chrfpp"], BOOT, "77", "truncate", ALPHA)


@query(f"WITH {MTSQL}, {CROSS} SELECT * EXCLUDE (delta, p, pb), round(delta, 4) AS delta, round(p, 6) AS p_value, round(pb, 6) AS p_value_bonferroni, pb < {ALPHA} AS significant_bonf FROM xs")
def st21_cross_system(spark, sf):
    r = _cross(spark, sf)
    return r.select("source", "target", "system_a", "system_b", "n_sentences", *[rounded(a, 4).alias(b) for a, b in (("score_a", "score_a"), ("score_b", "score_b"), ("delta", "delta"), ("lo", "ci_low"), ("hi", "ci_high"))], rounded("p").alias("p_value"), rounded("p_bonferroni").alias("p_value_bonferroni"), "significant_bonf")


@query(f"WITH {MTSQL}, {CROSS} SELECT count_if(pb < {ALPHA} AND delta > 0)::BIGINT AS wins_a, count_if(pb < {ALPHA} AND delta < 0)::BIGINT AS wins_b, count_if(NOT (pb < {ALPHA} AND delta <> 0))::BIGINT AS ties, 'chrfpp' AS metric FROM xs")
def agg12_win_counts(spark, sf):
    return SC.win_counts(_cross(spark, sf), ["metric"])

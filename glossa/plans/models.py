"""Queries of trained pieces, bootstraps with all replicates at once, and comparisons of methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import rules
from glossa.operators import encoders as EN
from glossa.operators import evaluate as EV
from glossa.operators import masking as MK
from glossa.operators import methods as ME
from glossa.operators import pieces as P
from glossa.operators import relational as R
from glossa.operators import resampling as RS
from glossa.operators import statistics as S
from glossa.operators import subwords as SW
from glossa.operators import tfidf as T
from glossa.plans.base import BLANK, DIMS, DISTANCES, H32, METHODS, ROLE, SENTENCES, distances, embeddings, group_vectors, method_distances, role, rounded, sentences, table
from glossa.sources import readers as RD

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- EMB5: pieces -------------------------------------------------------------------------------------------------

def _words(spark, sf):
    return P.marked_words(table(spark, sf, "documents").select(F.col("lang").alias("code"), "text"), ["code"], "text").persist()


@query()
def emb5_piece_model(spark, sf):
    """The whole set of 8000 pieces, as merges in their order."""
    merges = P.trained(_words(spark, sf).groupBy("word").agg(F.sum("n").alias("n")))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "step int, left string, right string")


#: All merges. A step of the SQL does as many of the best pairs as cannot touch each other's counts: up to the first that
#: meets one before it, whose left part could be made smaller within its own count, or that makes a symbol known already.
@query(f"""WITH RECURSIVE tok AS (SELECT lang AS code, unnest(regexp_split_to_array(text, '{BLANK}+')) AS w FROM documents),
ct AS (SELECT code, '▁' || w AS w, count(*) AS n FROM tok WHERE w <> '' GROUP BY ALL), wd AS (SELECT w, sum(n)::BIGINT AS n FROM ct GROUP BY w),
ch AS (SELECT c, sum(n)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(w, '(?s).')) AS c, n FROM wd) GROUP BY c),
al AS (SELECT c FROM (SELECT c, sum(n) OVER (ORDER BY n DESC, c) - n AS before, sum(n) OVER () AS total FROM ch) WHERE before < {P.COVERAGE}::DOUBLE * total),
st (w, n, s, wanted) USING KEY (w) AS (SELECT w, n, regexp_replace(w, '(.)', ' \\1 ', 'gs'), greatest(0, {P.VOCABULARY - P.SPECIAL} - (SELECT count(*) FROM al)) FROM wd
  UNION SELECT w, n, list_reduce(list_prepend({{'x': s, 'y': ''}}, ms), lambda p, q: {{'x': replace(p.x, q.x, q.y), 'y': ''}}).x, wanted - len(ms) FROM st, (
    WITH pr AS (SELECT p[1] AS a, p[2] AS b, sum(n)::BIGINT AS n FROM (SELECT unnest(list_zip(x[:-2], x[2:])) AS p, n FROM (SELECT string_split(trim(s), '  ') AS x, n FROM st) WHERE len(x) > 1) GROUP BY ALL),
    rk AS (SELECT a, b, row_number() OVER (ORDER BY n DESC, a, b) AS r, rank() OVER (ORDER BY n DESC) - 1 AS above FROM pr WHERE n >= 2 AND (length(a) > 1 OR a IN (SELECT c FROM al)) AND (length(b) > 1 OR b IN (SELECT c FROM al))),
    lm AS (SELECT q.r - 1 AS k FROM rk q JOIN (SELECT a, min(r) AS r FROM rk GROUP BY a) p ON q.b = p.a WHERE p.r <= q.r
      UNION ALL SELECT greatest(p.r, q.above) FROM rk q JOIN (SELECT b, min(r) AS r FROM rk GROUP BY b) p ON q.a = p.b WHERE p.r < q.r
      UNION ALL SELECT r FROM rk WHERE a || b IN (SELECT a FROM pr UNION ALL SELECT b FROM pr)
      UNION ALL SELECT r FROM rk QUALIFY row_number() OVER (PARTITION BY a || b ORDER BY r) > 1)
    SELECT list({{'x': ' ' || a || '  ' || b || ' ', 'y': ' ' || a || b || ' '}} ORDER BY r) AS ms FROM rk WHERE r <= greatest(1, coalesce((SELECT min(k) FROM lm), 1000000)) AND r <= (SELECT max(wanted) FROM st)) WHERE len(ms) > 0),
tf AS (SELECT code, term, sum(n) AS tf FROM (SELECT ct.code, ct.n, unnest(string_split(trim(s), '  ')) AS term FROM ct JOIN st USING (w)) GROUP BY ALL),
x AS (SELECT code, term, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT code) FROM tf)) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS x FROM tf)
SELECT code, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY code)), 6) AS w FROM x""")
def emb5_piece_tfidf(spark, sf):
    """Weights of the languages over all 8000 pieces of `emb5_piece_model`."""
    words = _words(spark, sf)
    merges = P.trained(words.groupBy("word").agg(F.sum("n").alias("n")))
    return P.piece_weights(words, ["code"], merges).select("code", "term", rounded("w").alias("w"))


# ---- ST6, ST7: bootstraps against gold ------------------------------------------------------------------------------

BOOT = 1000
GOLD = f"{DISTANCES}, gd AS (SELECT 'all' AS gold, a, b, d AS g FROM m WHERE a < b)"
SUMMARY = f"""bl AS (SELECT *, 'full' AS block FROM pr UNION ALL SELECT *, 'dialect_external' FROM pr WHERE ({ROLE.format('a')} = 'dialect' AND {ROLE.format('b')} = 'external') OR ({ROLE.format('b')} = 'dialect' AND {ROLE.format('a')} = 'external')),
rk AS (SELECT gold, block, it, rank() OVER (PARTITION BY gold, block, it ORDER BY d) + (count(*) OVER (PARTITION BY gold, block, it, d) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY gold, block, it ORDER BY g) + (count(*) OVER (PARTITION BY gold, block, it, g) - 1) / 2.0 AS ry FROM bl),
rho AS (SELECT gold, block, it, corr(rx, ry) AS r FROM rk GROUP BY ALL)
SELECT gold, block, round(max(r) FILTER (it = -1), 5) AS rho_observed, round(avg(r) FILTER (it >= 0), 5) AS rho_mean, round(quantile_cont(r, 0.025) FILTER (it >= 0), 5) AS rho_lo, round(quantile_cont(r, 0.975) FILTER (it >= 0), 5) AS rho_hi, count(r) FILTER (it >= 0) AS n_boot FROM rho GROUP BY ALL"""


def _summary(df):
    return df.select("gold", "block", *[rounded(c, 5).alias(c) for c in ("rho_observed", "rho_mean", "rho_lo", "rho_hi")], "n_boot")


def _golds(spark, sf):
    return distances(spark, sf).where("a < b").select(F.lit("all").alias("gold"), "a", "b", F.col("d").alias("g"))


@query(f"""WITH doc AS (SELECT conv_id * 100 + turn AS id, conv_id % 10 AS code, lower(text) AS t FROM conversations),
g AS (SELECT id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM doc), tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL),
nd AS (SELECT count(DISTINCT id) AS n FROM tf), df AS (SELECT term, count(*) AS df, row_number() OVER () AS t FROM tf GROUP BY term), x AS (SELECT id, t, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), nd),
wt AS (SELECT id, t, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x),
r AS (SELECT code, id, row_number() OVER (PARTITION BY code ORDER BY id) - 1 AS idx, count(*) OVER (PARTITION BY code) AS n FROM doc),
dr AS (SELECT code, it, {H32.format("'42-' || it || '-' || code || '-' || k")} % n AS idx, count(*) AS mult FROM (SELECT code, n, unnest(range(n)) AS k FROM (SELECT DISTINCT code, n FROM r)), (SELECT unnest(range({BOOT})) AS it) GROUP BY ALL),
mu AS (SELECT it::BIGINT AS it, code, id, mult FROM dr JOIN r USING (code, idx) UNION ALL SELECT -1, code, id, 1 FROM r),
ce AS (SELECT it, code, t, sum(mult * w) AS w FROM mu JOIN wt USING (id) GROUP BY ALL), ln AS (SELECT it, code, sqrt(sum(w * w)) AS l FROM ce GROUP BY ALL),
dt AS (SELECT p.it, p.code AS a, q.code AS b, sum(p.w * q.w) AS x FROM ce p JOIN ce q ON p.it = q.it AND p.t = q.t AND p.code < q.code GROUP BY ALL),
{GOLD}, pr AS (SELECT gold, p.it, gd.a, gd.b, greatest(0, 1 - coalesce(x, 0) / (p.l * q.l)) AS d, g FROM gd JOIN ln p ON p.code = gd.a JOIN ln q ON q.code = gd.b AND q.it = p.it LEFT JOIN dt ON dt.it = p.it AND dt.a = gd.a AND dt.b = gd.b),
{SUMMARY}""")
def st6_sparse_bootstrap(spark, sf):
    """All 1000 replicates of word TF-IDF centroids of ten groups of turns, over whole texts."""
    texts = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("conv_id") % 10).alias("code"), F.lower("text").alias("t"))
    tf = T.term_counts(texts, ["id"], F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).persist()
    return _summary(RS.sparse_bootstrap(texts, "code", T.weights(tf, tf, ["id"]), _golds(spark, sf), role, BOOT))


@query(f"""WITH {DISTANCES}, gd AS (SELECT 'half' AS gold, x.code AS a, y.code AS b, greatest(0.0, 1 - list_cosine_similarity(x.vec[1:32], y.vec[1:32])) AS g FROM c x JOIN c y ON x.code < y.code),
r AS (SELECT label AS code, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
dr AS (SELECT code, it, {H32.format("'42-' || it || '-' || code || '-' || k")} % n AS idx, count(*) AS mult FROM (SELECT code, n, unnest(range(n)) AS k FROM (SELECT DISTINCT code, n FROM r)), (SELECT unnest(range({BOOT})) AS it) GROUP BY ALL),
mu AS (SELECT it::BIGINT AS it, code, idx, mult FROM dr UNION ALL SELECT -1, code, idx, 1 FROM r),
rc AS (SELECT it, code, list(x ORDER BY i) AS vec FROM (SELECT it, code, i, sum(mult * embedding[i]::DOUBLE) AS x FROM mu JOIN r USING (code, idx), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY ALL),
pr AS (SELECT gold, p.it, gd.a, gd.b, greatest(0.0, 1 - list_cosine_similarity(p.vec, q.vec)) AS d, g FROM gd JOIN rc p ON p.code = gd.a JOIN rc q ON q.code = gd.b AND q.it = p.it),
{SUMMARY}""")
def st7_dense_bootstrap(spark, sf):
    """All 1000 replicates of sentence vectors; gold is what half of the dimensions say."""
    half = group_vectors(spark, sf).select("code", F.slice("vec", 1, DIMS // 2).alias("vec"))
    from glossa.functions import vectors as V

    golds = V.cosine_distances(half, "code").where("a < b").select(F.lit("half").alias("gold"), "a", "b", F.col("d").alias("g"))
    return _summary(RS.dense_bootstrap(embeddings(spark, sf), "code", ["vec_id"], golds, role, DIMS, BOOT))


# ---- ST13: methods with each other ----------------------------------------------------------------------------------


def _vectors(spark, sf, n: int = 4):
    """(method, code, vec): each method sees its own stretch of the dimensions."""
    width = DIMS // n
    parts = F.explode(F.array(*[F.struct(F.lit(f"m{k}").alias("method"), F.slice("vec", k * width + 1, width).alias("vec")) for k in range(n)]))
    return group_vectors(spark, sf).select("code", parts.alias("p")).select("p.method", "code", "p.vec")


JOINED = "j AS (SELECT x.method AS method_a, y.method AS method_b, x.a, x.b, x.d AS x, y.d AS y FROM mm x JOIN mm y ON x.a = y.a AND x.b = y.b AND x.method < y.method WHERE x.a < x.b)"


@query(f"""WITH {METHODS}, {JOINED}, k AS (SELECT method_a, method_b, rank() OVER (PARTITION BY method_a, method_b ORDER BY x) AS rx, rank() OVER (PARTITION BY method_a, method_b ORDER BY y) AS ry FROM j),
r AS (SELECT method_a, method_b, corr(rx, ry) AS rho FROM k GROUP BY ALL)
SELECT method_a, method_b, round(rho, 6) AS rho FROM r UNION ALL SELECT method_b, method_a, round(rho, 6) FROM r UNION ALL SELECT DISTINCT method, method, 1.0 FROM mm""")
def st13_rank_matrix(spark, sf):
    return ME.rank_correlations(method_distances(spark, sf)).select("method_a", "method_b", rounded("rho").alias("rho"))


@query(f"""WITH {METHODS}, {JOINED}, cs AS (SELECT DISTINCT code FROM cm), mp AS (SELECT DISTINCT method_a, method_b FROM j), pl AS (SELECT code AS tc, row_number() OVER (ORDER BY code) AS pos FROM cs),
pm AS (SELECT method_a, method_b, it, code, tc FROM (SELECT method_a, method_b, it, code, row_number() OVER (PARTITION BY method_a, method_b, it ORDER BY md5('42-' || method_a || '/' || method_b || '-' || it || '-' || code), code) AS pos FROM mp, cs, (SELECT unnest(range(999)) AS it)) JOIN pl USING (pos)),
mv AS (SELECT method_a, method_b, p.it, x, least(p.tc, q.tc) AS a, greatest(p.tc, q.tc) AS b FROM j JOIN pm p USING (method_a, method_b) JOIN pm q USING (method_a, method_b) WHERE p.code = j.a AND q.code = j.b AND q.it = p.it),
r AS (SELECT method_a, method_b, it, corr(mv.x, j.y) AS moved FROM mv JOIN j USING (method_a, method_b, a, b) GROUP BY ALL), s AS (SELECT method_a, method_b, corr(x, y) AS r FROM j GROUP BY ALL)
SELECT method_a, method_b, round(any_value(s.r), 6) AS mantel_r, round((count_if(moved >= s.r - 1e-12) + 1) / (count(*) + 1), 6) AS p_value, (SELECT count(*) FROM cs) AS n_varieties, (count_if(moved >= s.r - 1e-12) + 1) / (count(*) + 1) < 0.05 AS significant_005 FROM r JOIN s USING (method_a, method_b) GROUP BY ALL""")
def st13_mantel(spark, sf):
    return ME.mantel_table(method_distances(spark, sf)).select("method_a", "method_b", rounded("mantel_r").alias("mantel_r"), rounded("p_value").alias("p_value"), "n_varieties", "significant_005")


@query("""WITH e AS (SELECT label AS code, 'm' || ((i - 1) // 16)::VARCHAR AS method, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
g AS (SELECT p.method, p.code AS i, q.code AS j, sum(p.x * q.x) AS k FROM e p JOIN e q ON p.i = q.i AND p.method = q.method GROUP BY ALL),
c AS (SELECT method, i, j, k - avg(k) OVER (PARTITION BY method, i) - avg(k) OVER (PARTITION BY method, j) + avg(k) OVER (PARTITION BY method) AS k FROM g)
SELECT p.method AS method_a, q.method AS method_b, count(DISTINCT p.i) AS n_varieties, round(sum(p.k * q.k) / sqrt(sum(p.k * p.k) * sum(q.k * q.k)), 6) AS cka FROM c p JOIN c q ON p.i = q.i AND p.j = q.j AND p.method < q.method GROUP BY ALL""")
def st13_cka(spark, sf):
    return ME.space_table(_vectors(spark, sf)).select("method_a", "method_b", "n_varieties", rounded("cka").alias("cka"))


@query()
def st13_procrustes(spark, sf):
    return ME.space_table(_vectors(spark, sf)).select("method_a", "method_b", rounded("procrustes").alias("procrustes"))


# ---- EMB8: masked characters ----------------------------------------------------------------------------------------


def _case(x: str, cells: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} BETWEEN {between} THEN {then}" for between, then in cells) + f" ELSE {other} END"


def _ranges(number: str, point: str) -> tuple[str, str]:
    """SQL: the code point of a number, and the vocabulary number of a code point."""
    to, back, at = [], [], 0
    for a, b in rules.CODE_POINTS:
        to.append((f"{at} AND {at + b - a}", f"{number} + {a - at}"))
        back.append((f"{a} AND {b}", f"{point} + {at + 2 - a}"))
        at += b - a + 1
    return _case(number, to, "NULL"), _case(point, back, "1")


_TO, _BACK = _ranges(f"(h3 % {sum(b - a + 1 for a, b in rules.CODE_POINTS)})", "p")


@query(f"""WITH {SENTENCES}, ch AS (SELECT doc_id, pos, list_filter(string_split(text, ''), lambda c: c <> '') AS x FROM s WHERE text IS NOT NULL),
pt AS (SELECT doc_id, pos, unnest(range(greatest(ceil(len(x) / {MK.LENGTH - 2}), 1)::BIGINT)) AS part, x FROM ch),
sq AS (SELECT doc_id, pos, part, x[part * {MK.LENGTH - 2} + 1 : (part + 1) * {MK.LENGTH - 2}] AS x FROM pt),
po AS (SELECT doc_id, pos, part, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM sq WHERE len(x) > 0),
hs AS (SELECT *, unicode(c) AS p, md5('42-' || doc_id || '-' || pos || '-' || part || '-' || i) AS h FROM po),
nb AS (SELECT doc_id, pos, part, i, p, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT % 100 AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3 FROM hs),
ms AS (SELECT doc_id, pos, part, i, h1 < {int(MK.SHARE * 2**32)} AND p NOT IN (0, 57344, 57345, 57346, 57347) AS chosen, CASE WHEN h2 < 80 THEN 57347 WHEN h2 < 90 THEN {_TO} ELSE p END AS new, p, {_BACK} AS label FROM nb)
SELECT sq.doc_id, sq.pos::INTEGER AS pos, sq.part::INTEGER AS part, len(any_value(x)) + 2 AS n, count_if(chosen) AS n_chosen,
md5('57344,' || coalesce(string_agg((CASE WHEN chosen THEN new ELSE p END)::VARCHAR, ',' ORDER BY i) || ',', '') || '57345') AS ids_md5, md5('-100,' || coalesce(string_agg((CASE WHEN chosen THEN label ELSE -100 END)::VARCHAR, ',' ORDER BY i) || ',', '') || '-100') AS labels_md5
FROM sq LEFT JOIN ms ON ms.doc_id = sq.doc_id AND ms.pos = sq.pos AND ms.part = sq.part GROUP BY ALL""")
def emb8_masked_characters(spark, sf):
    """Every line of every document, whole: long lines go on in further sequences."""
    m = MK.masked(sentences(spark, sf).where("text IS NOT NULL"), ["doc_id", "pos"], "text")
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"))
    chosen = F.size(F.array_remove("labels", MK.IGNORED)).cast("long")
    return m.select("doc_id", "pos", "part", F.size("input_ids").cast("long").alias("n"), chosen.alias("n_chosen"), digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5"))


# ---- EMB3, EMB6, EMB7: encoders -------------------------------------------------------------------------------------


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("turn") % 5).alias("code"), "text")


@query()
def emb3_subword_skipgram(spark, sf):
    """Vectors of the groups' turns from a model trained on all of them."""
    from glossa.functions import vectors as V

    rows = _turns(spark, sf).withColumn("tokens", F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    model = SW.trained(rows, "id", dims=64, epochs=5, rows=1 << 14)
    vecs = SW.embedded(rows, ["id", "code"], "tokens", model)
    return vecs.groupBy("code").agg(V.mean_of("vec", 64).alias("vec")).select("code", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 4))


BYTES = "list_transform(range(16), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT / 127.5 - 1)"


def _pooled_sql(tokens: str, most: int, centre: bool) -> str:
    mean = "avg(x) OVER (PARTITION BY i)" if centre else "0"
    return f"""WITH tk AS (SELECT conv_id * 100 + turn AS id, ({tokens})[:{most}] AS t FROM conversations),
hs AS (SELECT id, md5(unnest(t)) AS h FROM tk), st AS (SELECT id, unnest(range(1, 17)) AS i, unnest({BYTES}) AS v FROM hs),
po AS (SELECT id, i, coalesce(avg(v), 0) AS x FROM (SELECT id, unnest(range(1, 17)) AS i FROM tk) LEFT JOIN st USING (id, i) GROUP BY ALL),
ce AS (SELECT id, i, x - {mean} AS x FROM po), nm AS (SELECT id, i, x / coalesce(nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0), 1) AS x FROM ce)
SELECT id, (i - 1)::INTEGER AS dim, round(x, 5) + 0.0 AS x FROM nm"""


def _components(vecs):
    return vecs.select("id", F.posexplode("vec").alias("dim", "x")).withColumn("x", rounded("x", 5))


@query(_pooled_sql(f"list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda w: w <> '')", EN.TOKENS, False))
def emb6_pooled_tokens(spark, sf):
    """Encoders of tokens: at most 128 of a turn, the limit of the encoder; all components."""
    return _components(EN.encode(_turns(spark, sf), ["id"], "text", EN.HashedTokens, 16))


@query(_pooled_sql("list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> '')", EN.CHARACTERS, True))
def emb7_centred_characters(spark, sf):
    """Encoders of characters: at most 512 of a turn; the mean of all turns taken off."""
    return _components(EN.encode(_turns(spark, sf), ["id"], "text", lambda: EN.HashedTokens(16, characters=True), 16, EN.CHARACTERS, centre=True))


# ---- EV10, TOP2, SMP2, JN6, SRC10 -----------------------------------------------------------------------------------


@query(f"""WITH {DISTANCES}, f AS (SELECT code, CASE code % 3 WHEN 0 THEN 'rom' WHEN 1 THEN 'dia' ELSE 'oth' END AS family FROM c),
kinds AS (SELECT 'family' AS kind, code, family FROM f UNION ALL SELECT 'romance vs rest', code, (family IN ('rom', 'dia'))::VARCHAR FROM f UNION ALL SELECT 'romance, no dialects', code, (family IN ('rom', 'dia'))::VARCHAR FROM f WHERE family <> 'dia'),
g AS (SELECT x.kind, m.a, x.family AS fa, y.family AS fb, avg(d) AS d FROM m JOIN kinds x ON x.code = m.a JOIN kinds y ON y.code = m.b AND y.kind = x.kind WHERE m.a <> m.b GROUP BY ALL),
k AS (SELECT kind, a, max(d) FILTER (fa = fb) AS own, min(d) FILTER (fa <> fb) AS other FROM g GROUP BY ALL)
SELECT kind AS score, round(avg(coalesce((other - own) / nullif(greatest(own, other), 0), 0)), 6) AS value FROM k GROUP BY kind""")
def ev10_scores(spark, sf):
    """The silhouettes of one evaluation, of groups in three made-up families."""
    v = group_vectors(spark, sf)
    families = v.select("code", F.when(F.col("code") % 3 == 0, "rom").when(F.col("code") % 3 == 1, "dia").otherwise("oth").alias("family"))
    ev = EV.Evaluation(v, families, DIMS, {"rom", "dia"}, {"dia"})
    out = spark.createDataFrame([(k, None if x is None else round(x, 6) + 0.0) for k, x in ev.scores().items()], "score string, value double")
    ev.close()
    return out


@query(f"""WITH {DISTANCES}, p AS (SELECT a, b, d FROM m WHERE a < b), h AS (SELECT 'head' AS part, row_number() OVER (ORDER BY d DESC, a, b) AS place, a, b, d FROM p QUALIFY place <= 20),
t AS (SELECT *, row_number() OVER (ORDER BY d, a DESC, b DESC) AS back FROM p) SELECT part, place::INTEGER AS place, a, b, round(d, 6) AS d FROM h
UNION ALL SELECT 'tail', row_number() OVER (ORDER BY d DESC, a, b)::INTEGER, a, b, round(d, 6) FROM t WHERE back <= 10""")
def top2_head_and_tail(spark, sf):
    pairs = distances(spark, sf).where("a < b")
    return R.head_tail(pairs, [("d", True), ("a", False), ("b", False)], 20, 10).withColumn("d", rounded("d"))


@query("SELECT doc_id, lang AS code, length(text)::BIGINT AS n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) <= 100")
def smp2_article_cap(spark, sf):
    """At most 100 articles of each language, drawn before anything is cleaned."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("code"), "text")
    return R.sample_n(d, ["code"], 100, "42", ["doc_id"]).select("doc_id", "code", F.length("text").cast("long").alias("n_chars"))


@query(f"""WITH {DISTANCES}, md AS (SELECT a, b, d FROM m WHERE a < b AND a <> 3 AND b <> 3), gd AS (SELECT a, b, d AS g FROM m WHERE a < b AND a <> 5 AND b <> 5 UNION ALL SELECT 97, 98, 0.5),
j AS (SELECT * FROM md JOIN gd USING (a, b)), r AS (SELECT rank() OVER (ORDER BY d) AS rx, rank() OVER (ORDER BY g) AS ry FROM j)
SELECT (SELECT count(DISTINCT c) FROM (SELECT a AS c FROM j UNION ALL SELECT b FROM j)) AS n_shared, count(*) AS n_pairs, round(corr(rx, ry), 6) AS rho FROM r""")
def jn6_shared_codes(spark, sf):
    """A model that lacks one group and a gold that lacks another and has two of its own: what both have is compared."""
    m = distances(spark, sf).where("a < b")
    extra = spark.createDataFrame([(97, 98, 0.5)], "a int, b int, g double")
    gold = m.where("a <> 5 AND b <> 5").withColumnRenamed("d", "g").unionByName(extra)
    j = m.where("a <> 3 AND b <> 3").join(gold, ["a", "b"])
    rho = S.spearman(j, [], "d", "g")
    n = j.select(F.explode(F.array("a", "b")).alias("c")).agg(F.count_distinct("c").alias("n_shared"))
    return n.join(rho).select("n_shared", F.col("n").alias("n_pairs"), rounded("rho").alias("rho"))  # one row each


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'devtest' END AS split, doc_id, md5(regexp_replace(text, '\\r?\\n', ' ', 'g')) AS text FROM documents")
def src10_splits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    parts = RD.splits({"dev": d.where("doc_id % 2 = 0"), "devtest": d.where("doc_id % 2 <> 0")}, ["doc_id"])
    return parts.select("split", "doc_id", F.md5("text").alias("text"))


@query(f"SELECT method_a, method_b, p_value, round(least(p_value * count(*) OVER (PARTITION BY method_a), 1), 6) AS p_bonferroni FROM ({SQL['st13_mantel']})")
def st19_mantel_bonferroni(spark, sf):
    """The permutation tests of each method against the others, corrected for their number."""
    m = ME.mantel_table(method_distances(spark, sf)).select("method_a", "method_b", rounded("p_value").alias("p_value"))
    return m.withColumn("p_bonferroni", rounded(S.bonferroni("p_value", ["method_a"])))

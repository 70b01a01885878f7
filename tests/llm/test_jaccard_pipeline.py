import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from glossa.llm import components as K
from glossa.llm import jaccard_join as J
from glossa.llm import toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def groups(sets):
    """Smallest index reachable by links."""
    at = list(range(len(sets)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def near_copies(r, n=120):
    vocab = [f"w{i}" for i in range(400)]
    texts, base = [], [" ".join(r.choice(vocab) for _ in range(r.randrange(3, 120))) for _ in range(12)]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    for _ in range(n):
        ws = r.choice(base).split()
        for _ in range(r.randrange(0, 4)):
            ws[r.randrange(len(ws))] = r.choice(vocab)
        if r.random() < 0.3:
            ws += passage.split()[: r.randrange(30)]
        texts.append("  ".join(ws).upper() if r.random() < 0.2 else " ".join(ws))
    return [None, "", " \t\n", "one", "one", "One", "a b c d", "a b c d e", *texts, *texts[:6]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(table, seed):
    texts = near_copies(random.Random(seed))
    sets = [shingle_set(t) for t in texts]
    want = groups(sets)
    got = {r["doc_id"]: r for r in J.near_duplicates(table(texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), want[i]), texts[i]


def test_metric_join_with_regions_equals_all_pairs():
    r = np.random.default_rng(0)
    for trial in range(12):
        base = [r.choice(4000, 60, replace=False) for _ in range(6)]
        sets = []
        for _ in range(150):
            s = set(base[r.integers(6)].tolist())
            for _ in range(r.integers(0, 16)):
                s.discard(int(r.choice(sorted(s))))
                s.add(int(r.integers(4000)))
            sets.append(s)
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        assert J.connect(arrays, np.array([len(s) for s in sets])) == groups(sets), trial


def spaces_of(r):
    """Texts whose candidate graph has a chain, a cloud of near copies and a pair of clouds just too far apart."""
    word = lambda: f"w{r.randrange(10**9)}"
    chain = [word() for _ in range(1000)]
    texts = [" ".join(chain[3 * i : 3 * i + 60]) for i in range(300)]
    for shift in (0, 1):
        base = [word() for _ in range(150)] if not shift else [*base[:128], *[word() for _ in range(22)]]  # noqa: F821
        for _ in range(150):
            ws = list(base)
            for _ in range(r.randrange(0, 3)):
                ws[r.randrange(len(ws))] = word()
            texts.append(" ".join(ws))
    return texts


@pytest.mark.parametrize("leaf", [20, 256])
def test_large_spaces_are_cut_over_the_cluster(table, leaf, monkeypatch):
    monkeypatch.setattr(J, "LEAF_SETS", leaf)
    monkeypatch.setattr(J, "BLOCK_SETS", 40)
    texts = spaces_of(random.Random(leaf))
    sets = [shingle_set(t) for t in texts]
    want = groups(sets)
    got = {r["doc_id"]: r["component_id"] for r in J.near_duplicates(table(texts)).collect()}
    assert len(set(want)) > 1 and [got[i] for i in range(len(texts))] == want


def test_a_chain_of_5000(table):
    ws = [f"w{i}" for i in range(20100)]
    texts = [" ".join(ws[4 * i : 4 * i + 80]) for i in range(5000)]
    texts[2500], texts[2501] = "cut " * 9, ""
    got = {r["doc_id"]: r["component_id"] for r in J.near_duplicates(table(texts)).collect()}
    assert got == {i: 0 if i < 2500 else i if i < 2502 else 2502 for i in range(5000)}


def test_hashes_keep_what_the_bucket_does_not_tell(table):
    """Whatever the number of buckets, and so of bits that are left out, the sets come back the same."""
    texts = near_copies(random.Random(9), 40)
    want = None
    for buckets in (2, 7, 200, 9000):
        rows = J.shingle_lists(table(texts), buckets, "doc_id", "text", 5, 80).collect()
        lens = sorted((bytes(r["key"]), None if r["shared"] is None else len(r["shared"])) for r in rows)
        want = want or lens
        assert lens == want


def test_size_classes_hold_partners():
    from bisect import bisect_right

    bounds = J.size_classes(80)
    for n in range(1, 3000):
        assert bisect_right(bounds, n * 100 // 80) - bisect_right(bounds, n) <= 1


def test_prefix_lengths_are_safe():
    for n in range(1, 300):
        assert 100 * J.needed(n) >= 80 * n > 100 * (J.needed(n) - 1) and 1 <= J.prefix(n) <= n


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in K.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
    assert K.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_null_and_clashing(spark):
    long = " ".join(f"x{i}" for i in range(50))
    rows = [(None, long, 1, 1), (5, long, 2, 7), (5, long, 2, 6), (9, "y " * 9, 3, 1), (9, "z " * 9, 4, 1), (None, None, 5, 1), (None, None, 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, key int")
    got = sorted(str((r["doc_id"], r["component_id"])) for r in J.near_duplicates(df).collect())
    assert got == sorted(["(None, 5)", "(5, 5)", "(5, 5)", "(9, 9)", "(9, 9)", "(None, None)", "(None, None)"])
    kept = J.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == 5 and [r["key"] for r in kept.where("doc_id = 5").collect()] == [6] and J.one_of_each(df.limit(0)).count() == 0


def test_pipeline_equals_plain_python(spark):
    """The stages, redone text by text with sets, loops and the tokenizer's own library."""
    import corpus_pipeline as C
    from tests_support import brute_cut, brute_mask, brute_private_spans

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [(i, t) for i, t in rows if model.grades(t.encode())[0] < 0.5]
    sets = [shingle_set(t) for _, t in rows]
    rows = [x for k, (x, g) in enumerate(zip(rows, groups(sets), strict=True)) if k == g or not sets[k]]
    rows = [(i, c) for i, t in rows if (c := brute_cut(t, bench)) is not None]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(C.TOKENIZER))
    spans = brute_private_spans([t for _, t in rows])
    want = {i: hashlib.sha256(" ".join(map(str, lib.encode(brute_mask(t, s), add_eos=True))).encode()).hexdigest() for (i, t), s in zip(rows, spans, strict=True)}
    got = {r["doc_id"]: r["ids_sha256"] for r in C.run(spark, sf).select("doc_id", "ids_sha256").collect()}
    assert got == want


def test_stages_keep_columns_and_empty_tables(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (2, "clean little text", "en", "s", 17)], docs.schema)).withColumn("label", F.lit(1))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, few, sf)
        assert out.columns == few.columns and out.count() == 2, name
        assert stage(spark, few.limit(0), sf).count() == 0, name
    assert C.STAGES[-1][1](spark, few, sf).count() == 2


def test_stages_with_awkward_columns(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    text = "clean little text and more"
    few = docs.unionByName(spark.createDataFrame([(1, text, "en", "s", 26), (2, None, None, None, None), (3, "= " + " " * 100_000 + "x", "en", "s", 100_003)], docs.schema))
    for c in ("x.y", "key", "digest", "position", "sequence", "row", "spans"):
        few = few.withColumn(c, F.lit(1))
    for name, stage in C.STAGES:
        out = stage(spark, few, sf)
        assert out.count() == 3 and (name == C.STAGES[-1][0] or out.columns == few.columns), name

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm import media as M
from glossa.llm import warc as W
from glossa.llm.piece_codec import PieceCodec, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_normaliser_keeps_every_record():
    raw = [W.record("response", i, f"http://x/{i}", bytes([i]) * (i * 50_000), "d", None) for i in range(4)]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out, index = W.normalise(c.compress(b"".join(raw)) + c.flush())
    assert [zlib.decompress(out[o : o + n], 31) for o, n, *_ in index] == raw
    assert b"".join(W.inflate(out)) == b"".join(raw)
    with pytest.raises(ValueError):
        list(W.records_of(iter([raw[1][:-10]])))


def test_pages_round_trip(spark):
    big = "é<p>" * 40
    rows = [(1, "u1", big), (2, None, big), (3, "u 3", "short"), (4, "u4", "short"), (5, "u", None), (6, "u", ""), (0, "u\r\nX: y", big + "x"), (2, "again", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload")
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.normalise_archives(df, 200).collect())
    want = sorted((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and p != 1 else "response", 1 if h == big and p != 1 else None) for p, _, h in rows)
    assert [str(x) for x in got] == [str(x) for x in want]
    assert W.normalise_archives(df.limit(0)).count() == 0


def test_ids_of_any_type_and_valid_headers(spark):
    big = "x" * 150
    rows = [("a b>", "http://h/é ü", big), ("b", None, big), ("", "u", "s"), ("null", "u", "s"), (None, "u", "s")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in W.normalise_archives(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {"a b>": ("response", None), "b": ("revisit", "a b>"), "": ("response", None), "null": ("response", None), None: ("response", None)}
    for kind, refers in (("response", None), ("revisit", 1)):
        fields, body = W.parse(W.record(kind, 2, None, b"pay\r\n\r\nload", "ab", refers))
        assert fields.keys() >= {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type", "Content-Length", "WARC-Target-URI"}
        assert (kind == "revisit") == ("WARC-Profile" in fields)
        assert W.answer_of(body) == (11, b"pay\r\n\r\nload" if kind == "response" else b"")


def test_hot_payload(spark):
    df = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN repeat('y', 100) ELSE concat(id, repeat('z', 100)) END AS html")
    got = {tuple(r): n for *r, n in W.normalise_archives(df).groupBy("record_type", "refers_to").count().collect()}
    assert got == {("response", None): 2001, ("revisit", 1): 999}


def test_png_round_trip():
    for n in (0, 1, 191, 192, 193, 5000):
        t = bytes(random.Random(n).randrange(256) for _ in range(n))
        p = M.padded(t)
        assert len(p) % 192 == 0 and len(p) > 0 and p.startswith(t) and set(p[n:]) <= {32}
        assert M.from_png(M.to_png(p)).tobytes() == p
    with pytest.raises(ValueError):
        M.from_png(M.to_png(p)[:-20] + b"x" * 20)


def test_sequence_keeps_order_and_captions():
    page = "<h1>T</h1><p>a<img src='u1' alt='alt'>b</p><figure><img src='sha256:ab'><img src='u2'><figcaption>the <b>cap</b></figcaption></figure><script>no</script>end"
    got = [(x["position"], x["kind"], x["text"], x["caption"]) for x in M.sequence(page)]
    assert got == [(0, "text", "Ta", None), (1, "media", None, "alt"), (2, "text", "b", None), (3, "media", None, "the cap"), (4, "media", None, "the cap"), (5, "text", "end", None)]
    first = "<figure><figcaption>c</figcaption><img src='u'></figure><img src='v'>"
    assert [x["caption"] for x in M.sequence(first)] == ["c", None]
    assert M.sequence(None) == [] and M.sequence(page)[3]["digest"] == "ab"


def test_documents_as_media(spark, table):
    texts = [None, "", "a", "a ", "é" * 300, "a", "<b>&amp;</b>\n" * 50]
    rows = {r["doc_id"]: r for r in M.documents_as_media(table(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        p = M.padded((t or "").encode())
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r["media_sha256"] == hashlib.sha256(M.to_png(p)).hexdigest() and r["caption"].startswith(str(r["n_bytes"]))
    assert rows[2]["feature"] == rows[5]["feature"]
    assert [(rows[i]["position"], rows[i]["chars_before"], rows[i]["chars_after"]) for i in (0, 2, 4)] == [(0, 0, 0), (0, 0, 1), (1, 150, 150)]
    assert M.documents_as_media(table([])).count() == 0
    clash = table(["a"]).selectExpr("*", "1 AS digest", "2 AS html", "3 AS sequence", "4 AS media", "5 AS position", "6 AS s")
    assert M.documents_as_media(clash).count() == 1


def test_document_pages_keep_the_text(spark, table):
    texts = ["one <b> & two", "é" * 301, "a\r\n&amp;b</p>c", "x" * 200_000]
    for r in M.sequences(M.wrapped(table(texts))).collect():
        kinds = [s["kind"] for s in r["sequence"]]
        assert kinds == ["text", "media", "text"] and "".join(s["text"] for s in r["sequence"] if s["text"]) == texts[r["doc_id"]]


def test_interleaved_pages(spark):
    pages = spark.createDataFrame([(1, "<img src='sha256:00'>x<img src='sha256:11' alt='c'>yz"), (2, None)], "page_id long, html string")
    known = spark.createDataFrame([("11", 5)], "digest string, size int")
    seqs = M.sequences(pages)
    got = [(r["position"], r["size"], r["chars_before"], r["chars_after"]) for r in M.resolve(seqs, known).orderBy("position").collect()]
    assert got == [(0, None, 0, 3), (2, 5, 1, 2)]
    rows = {r["page_id"]: [(i["position"], i["text"], i["caption"], i["media"] and i["media"]["size"]) for i in r["items"]] for r in M.interleaved(seqs, "page_id", known).collect()}
    assert rows == {1: [(0, None, None, None), (1, "x", None, None), (2, None, "c", 5), (3, "yz", None, None)], 2: []}


@pytest.fixture(scope="module")
def codecs():
    with open(MODEL, "rb") as f:
        return PieceCodec(f.read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(t=st.text(max_size=60) | st.text(alphabet="abe hilnost\n▁'.0,é漢", max_size=80))
def test_codec_equals_the_library(codecs, t):
    own, lib = codecs
    want = lib.encode(t, add_eos=True)
    assert own.encode(t) == want and own.decode(want) == lib.decode(want)
    assert own.coded(t) == (" ".join(map(str, want)), lib.decode(want))


def test_codec_on_runs_and_pieces(codecs):
    own, lib = codecs
    r = np.random.default_rng(0)
    pieces = list(own.ids)
    made = ["".join(r.choice(pieces, 6)).replace("▁", " ") for _ in range(800)]
    for t in [*made, "a" * 3000, "ab" * 2000, " " * 999, "hello" * 700, "é" * 500, "1" * 999, "=" * 3000]:
        assert own.encode(t) == lib.encode(t, add_eos=True), t[:80]
    assert own.decode([1, 3 + 0xE6, 3 + 0xBC, 2]) == lib.decode([1, 3 + 0xE6, 3 + 0xBC, 2])


def test_encode_documents(table, codecs):
    texts = [None, "", "Hello  world\n", "Hello  world\n", "x" * 50_000]
    rows = {r["doc_id"]: r for r in encode_documents(table(texts), MODEL, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = codecs[1].encode(t or "", add_eos=True)
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(codecs[1].decode(ids).encode()).hexdigest()
    assert encode_documents(table([]), MODEL).count() == 0


def test_page_columns_with_names_of_the_result(spark):
    digests = {k: hashlib.sha256(M.padded(k.encode())).hexdigest() for k in ("one", "two")}
    html = f'a<img src="sha256:{digests["one"]}">b<img src="sha256:{digests["two"]}" alt="z">'
    pages = spark.createDataFrame([(1, html, digests["two"], 7, "cap", "seq", 5, 6)], "id long, html string, digest string, position int, caption string, sequence string, `x.y` int, page_digest int")
    known = spark.createDataFrame([(d, k) for k, d in digests.items()], "digest string, payload string")
    got = M.resolve(M.sequences(pages), known)
    assert len(set(got.columns)) == len(got.columns) and "page_sequence" in got.columns and "x.y" in got.columns
    rows = [r.asDict() for r in got.orderBy("position").collect()]
    assert [r["payload"] for r in rows] == ["one", "two"] and [r["position"] for r in rows] == [1, 3]
    assert all(r["page_position"] == 7 and r["page_caption"] == "cap" and r["page_sequence"] == "seq" and r["x.y"] == 5 for r in rows)
    assert {r["page_page_digest"] for r in rows} | {r["page_digest"] for r in rows} == {6, digests["two"]}


def test_codec_steps_back_as_the_library_does():
    import random

    import public_tokenizers
    import sentencepiece

    from glossa.llm.piece_codec import PieceCodec

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        codec = PieceCodec(f.read())
    r = random.Random(11)
    for alphabet in ("ab", "ints", "aeiou tr", "estrn-\n", "é漢a \u0001😀"):
        for _ in range(300):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 40)))
            ids = library.encode(text, add_eos=True)
            assert codec.coded(text) == (" ".join(map(str, ids)), library.decode(ids)), text
            assert codec.decode(ids) == library.decode(ids)
    assert not codec.byte_ids & set(codec.encode("plain words", end=False))


def test_codec_remembers_little_and_keeps_what_is_in_use():
    import gc
    import random
    import tracemalloc

    from glossa.llm.piece_codec import _Memory

    with open(MODEL, "rb") as f:
        codec = PieceCodec(f.read())
    r = random.Random(5)
    words = ["".join(r.choice(["th", "wh", "ing", "er", "lich", "tion", "que", "é"]) for _ in range(6)) for _ in range(20_000)]
    codec.coded(" ".join(words[:2000]))
    gc.collect()
    tracemalloc.start()
    codec.coded(", ".join(words[2000:]))
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 18_000 * 2 * 200  # a word alone and with its comma

    made = []
    memory = _Memory(lambda k: made.append(k) or len(k), limit=10)
    for i in range(200):
        assert memory["often"] == 5 and memory[f"once {i}"] == len(f"once {i}")
        assert len(memory) <= 10 and len(memory.before) <= 10
    assert made.count("often") == 1 and len(made) == 201


def test_codec_of_units_that_decode_otherwise(codecs):
    own, lib = codecs
    for t in ("a▁b c", "▁▁", " ▁ x", "plain words ▁", "▁" * 100 + " é", "漢\u0001▁y " * 30):
        ids = lib.encode(t, add_eos=True)
        assert own.coded(t) == (" ".join(map(str, ids)), lib.decode(ids)), t


def test_a_codec_is_let_go_at_once():
    import gc
    import weakref

    from glossa.llm.common import forgotten
    from glossa.llm.piece_codec import codec_of

    with open(MODEL, "rb") as f:
        model = f.read()
    gc.disable()
    try:
        codec = codec_of(model)
        assert codec_of(model) is codec and codec.coded("some words")
        seen = weakref.ref(codec)
        del codec
        forgotten()
        assert seen() is None
    finally:
        gc.enable()


def test_lean_encoding_gives_the_same_rows(table):
    rows = lambda **how: sorted(map(tuple, encode_documents(table([None, "", "Hello  world\n", "▁é漢 x" * 50, "x" * 5000]), MODEL, keep_ids=True, **how).collect()))
    assert rows(lean=True) == rows()

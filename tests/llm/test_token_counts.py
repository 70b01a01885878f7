import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from glossa.llm import token_counts as T

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def counter(path):
    with open(path, "rb") as f:
        return T.TokenCounter(path, f.read())


def test_pieces_add_up_on_awkward_texts(library, monkeypatch):
    monkeypatch.setattr(T, "LONG", 20)
    r, c = random.Random(3), counter(JSON)
    parts = [*"ab'sl9 5\n\t\r\v\f\x1c\x85　​!|<>.é中٣ⅷ\x00", " ", "<|endoftext|>", "'ll", "    "]
    for _ in range(8000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(0, 40)))
        assert c.counts([t]) == [len(library.encode(t, add_special_tokens=False))], repr(t)
        assert "".join(T.byte_level_pieces(t)) == t


def test_boundaries_only_where_they_hold():
    usual = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE"}, "added_tokens": []}
    token = {"content": "<x>", "lstrip": False, "rstrip": False, "single_word": False, "normalized": False}
    assert T.cuts_at_blanks(usual | {"added_tokens": [token]})
    for change in ({"content": "a b"}, {"content": "a1"}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}):
        assert not T.cuts_at_blanks(usual | {"added_tokens": [token | change]})
    assert not T.cuts_at_blanks(usual | {"normalizer": {"type": "Lowercase"}})
    assert not T.cuts_at_blanks(usual | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}})


def test_slices_are_balanced_and_whole():
    import pyarrow as pa

    texts = pa.array(["a" * 30, None, "b", "c" * 500, "", "d" * 40, "e" * 40, "f" * 40])
    parts = list(T.slices(texts, 100))
    assert [a for a, _ in parts] == [0, *(b for _, b in parts)][:-1] and parts[-1][1] == 8
    assert all(b - a == 1 or sum(len(t or "") for t in texts[a:b].to_pylist()) <= 100 for a, b in parts)
    assert list(T.slices(texts.slice(0, 0))) == []


@pytest.mark.parametrize("path", [JSON, MODEL, public_tokenizers.path("word_bpe_49k.json")])
def test_counts_are_the_librarys(table, path):
    r = random.Random(1)
    texts = [None, "", " ", "x" * 50_000, "a1" * 9000, "word " * 20_000, "<|endoftext|> <|endoftext|>", "tie", "tie", "\n" * 300]
    texts += ["".join(r.choice("abc dé\n,1") for _ in range(r.randrange(900))) for _ in range(60)]
    got = T.count_tokens(table(texts), path).orderBy("doc_id").collect()
    if path.endswith(".json"):
        library = Tokenizer.from_file(path)
        want = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    else:
        want = [len(x) for x in SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    assert [r["n_tokens"] for r in got] == want
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in texts]
    assert [r["over_limit"] for r in got] == [n > 512 for n in want]


def test_other_columns_and_ids(spark):
    df = spark.createDataFrame([(None, "two words", 1, 2), (3, "two words", 1, 2), (3, "two words", 1, 2)], "doc_id long, text string, `n_tokens` int, `x.y` int")
    assert sorted(str(r["doc_id"]) for r in T.count_tokens(df, JSON).collect()) == ["3", "3", "None"]
    assert T.count_tokens(df.limit(0), JSON).count() == 0
    with pytest.raises(ValueError):
        T.TokenCounter("x.txt", b"")

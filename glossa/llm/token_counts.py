"""Token counts of whole texts, as a public tokenizer's own library gives them; ids never leave the task.

Texts are cut at boundaries that no token can cross, so that their counts add up: for byte-level merges, between a
character that is no white space and an ASCII blank after it, and, in stretches without blanks, between ASCII letters
and digits. The pieces between boundaries are mostly words; a worker remembers the counts of short pieces, and pieces
it has not met go to the library together, in batches of about the same number of bytes, so that a long text is no
batch of its own and many short ones are no more than one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import KEPT, trimmed

#: Texts above this many tokens are marked.
LIMIT = 512
#: Bytes of text in a slice of a batch, and bytes of pieces that the library encodes in one call.
SLICE_BYTES, CALL_BYTES = 8 << 20, 256 << 10
#: Characters of a piece that is remembered, how many a worker remembers, and characters above which a piece without
#: blanks is cut again.
SHORT, REMEMBERED, LONG = 48, 500_000, 4096

#: A piece ends before an ASCII blank if its last character is no white space. Other white space stays inside, as the
#: library and this pattern need not agree on what is white space outside ASCII.
PIECES = re.compile(r"\s*\S+(?:[^\S \t\n\r]\s*\S+)*(?:[^\S \t\n\r]\s*\Z)?|\s+").findall
#: In a long piece: letters and digits are never in one token.
CUTS = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def _whole(text: str) -> list[str]:
    return [text] if text else []


def byte_level_pieces(text: str) -> list[str]:
    """The text cut at safe boundaries of byte-level merges; joined, the pieces are the text."""
    found = PIECES(text)
    if len(text) > LONG and any(len(p) > LONG for p in found):
        found = [q for p in found for q in (CUTS.split(p) if len(p) > LONG else (p,))]
    return found


def cuts_at_blanks(spec: dict) -> bool:
    """Whether the boundaries hold for a tokenizer file: byte-level merges with the usual pattern, nothing that
    normalises, and no added token that holds or takes blanks, or mixes letters and digits."""
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"\s", t["content"]) and not CUTS.search(t["content"]) for t in added)
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return usual and plain and spec.get("normalizer") is None and (spec.get("model") or {}).get("type") == "BPE"


class TokenCounter:
    """Counts of one tokenizer file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, name: str, content: bytes):
        self.known: dict[str, int] = {}
        if name.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_buffer(content)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.pieces: Callable[[str], list[str]] = byte_level_pieces if cuts_at_blanks(json.loads(content)) else _whole
            encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
            self.lengths = lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]
        elif name.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            processor = SentencePieceProcessor(model_proto=content)
            self.pieces = _whole
            self.lengths = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"neither a .json nor a .model file: {name}")

    def encoded(self, pieces: list[str]) -> list[int]:
        """Counts of pieces, encoded in calls of about CALL_BYTES each."""
        ends = np.cumsum([len(p.encode()) for p in pieces], dtype=np.int64)
        cuts = np.flatnonzero(np.diff(ends // CALL_BYTES, prepend=-1)).tolist()
        return [n for a, b in zip(cuts, [*cuts, len(pieces)][1:], strict=True) for n in self.lengths(pieces[a:b])]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self.pieces(t) for t in texts]
        new = [p for p in set(chain.from_iterable(cut)) if p not in self.known]
        self.known.update(zip(new, self.encoded(new), strict=True))
        out = [sum(map(self.known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > SHORT:
                del self.known[p]
        return out


_COUNTERS: dict[tuple, TokenCounter] = {}
KEPT.append(_COUNTERS)


def counter_of(name: str, content: bytes) -> TokenCounter:
    """This worker's counter of a file: what one task has learned of pieces serves the next."""
    key = (name, hashlib.sha256(content).digest())
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(name, content)
    return _COUNTERS[key]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about the same number of bytes; a text above the limit ends its range."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, to
        at = to


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): UTF-8 bytes and tokens of every whole text, without added begin, end or
    other special tokens; special strings inside texts count as the library counts them.

    The file (its size does not depend on the data) goes to the workers once. A null text is empty: no bytes, no
    tokens. Rows stay rows, repeated and null ids included; a text of any length is counted as a whole; an empty table
    gives an empty result; other columns, whatever their names, are ignored. Nothing is exchanged.
    """
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    name = os.path.basename(path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(name, content.value)
        for b in batches:
            for start, end in slices(b.column(1)):
                ids, texts = (c.slice(start, end - start) for c in b.columns)
                n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
                n = np.array(counter.counts([t or "" for t in texts.to_pylist()]), np.int64)
                yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        trimmed()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

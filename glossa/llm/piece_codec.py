"""Exact encoding and decoding with a merge-type SentencePiece model, without replaying its merges.

A token sequence is what the merges would give if and only if every two neighbours, merged again from characters,
come out as the same two tokens. So: at each position take the longest match of an Aho-Corasick automaton over the
pieces; keep it if it is compatible with the token before; else try the next shorter piece; else step back, and note
the position in a bitfield of those from which no encoding exists, so that it is never entered twice. Compatibility
is found by merging the two tokens' characters again, and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import KEPT, forgotten, trimmed

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: Entries of a worker's memory of words, and of its memory of neighbours, that are in use: as many again are kept from
#: before, at 200 bytes each, so that two workers and a JVM that earlier stages have filled share an executor of 3 GB.
REMEMBERED = 200_000
LONG_UNIT = 64


class _Memory(dict):
    """Results by key, computed when first asked for. When full it starts anew, and takes over from what it held before
    what is asked for again; what it held before that is let go. `key` gives an equal key of shared parts to keep."""

    def __init__(self, make, limit: int = REMEMBERED, key=None):
        super().__init__()
        self.make, self.limit, self.key, self.before = make, limit, key, {}

    def __missing__(self, key):
        out = self.before.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        if not isinstance(key, str) or len(key) <= LONG_UNIT:
            self[self.key(key) if self.key else key] = out
        return out


class _Odd(str):
    """Ids of a unit that decodes to another text."""

    back: str


class PieceCodec:
    """Encoder and decoder of one model file's bytes. Models that normalise text or have user-defined or unused
    pieces are refused: their texts would need more than merges."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models without text normalisation are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.unk, self.eos = proto.trainer_spec.unk_id, proto.trainer_spec.eos_id
        self.unk_surface = proto.trainer_spec.unk_surface
        self.surfaces = [self.unk_surface if p.type == UNKNOWN else "" if p.type == CONTROL else p.piece.replace(SPACE, " ") for p in proto.pieces]
        self.ids, self.scores, self.bytes = {}, {}, {}
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
            elif p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.byte_ids = frozenset(self.byte_of)
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}  # no merge crosses any other two characters
        self.units = re.compile(self._cutter()).findall
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p) - 1)
        self.automaton.make_automaton()
        self.own = {p: p for p in self.ids}
        self.known = _Memory(self._unit, remembered)
        self.pairs = _Memory(self._compatible, remembered, key=lambda pair: (self.own.get(pair[0], ""), self.own[pair[1]]))
        self.shorter = _Memory(self._shorter)

    def _cutter(self) -> str:
        """A pattern that cuts texts only where no merge crosses: before blanks (or their marks), around line ends, between
        letters and others, each as far as the pieces allow; a model whose pieces allow none is given whole texts."""
        letter = re.compile(r"[^\W\d_]").match
        if any(b == SPACE != a for a, b in self.joins):
            return "(?s).+"
        stop = "" if any("\n" in j for j in self.joins) else "\n"
        mixed = any(SPACE not in j and bool(letter(j[0])) != bool(letter(j[1])) for j in self.joins)
        rest = f"[^ {SPACE}{stop}]+" if mixed else rf"[^\W\d_]+|(?:(?![^\W\d_])[^ {SPACE}{stop}])+"
        return f"(?s)[ {SPACE}]*(?:{rest})|[ {SPACE}]+" + ("|\n" if stop else "")

    def merged(self, text: str) -> list[str]:
        """The merges themselves, on a short string: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, pair: tuple[str, str]) -> bool:
        return self.merged(pair[0] + pair[1]) == [*pair] if pair[0] else self.merged(pair[1]) == [pair[1]]

    def _shorter(self, piece: str) -> str:
        """The longest proper prefix that is a piece; empty if none is."""
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), "")

    def backtracked(self, text: str) -> list[str]:
        """Pieces of a string all of whose characters are pieces."""
        longest = {end - n: end + 1 for end, n in self.automaton.iter(text)}  # later matches of a start are longer
        pairs, shorter, size = self.pairs, self.shorter, len(text)
        out: list[str] = []
        before, pos, end, dead, stuck = "", 0, longest[0], bytearray(size // 8 + 1), False
        token = text[:end]
        while True:
            if not (stuck and dead[end >> 3] >> (end & 7) & 1) and pairs[before, token]:
                out.append(token)
                if end == size:
                    return out
                before, pos, end = token, end, longest[end]
                token = text[pos:end]
                continue
            token = shorter[token]
            while not token:
                stuck = True
                dead[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= len(token)
                token = shorter[token]
            before, end = out[-1] if out else "", pos + len(token)

    def _part(self, text: str) -> list[int]:
        """Ids of a stretch that no merge leaves."""
        if len(text) == 1 and text not in self.ids:
            return [self.bytes[b] for b in text.encode()] if self.byte_fallback else [self.unk]
        return [self.ids[p] for p in self.backtracked(text)]

    def _unit(self, text: str) -> str:
        """The decimal ids of a unit, joined by blanks. What several stretches make up is put together from them."""
        marked = text.replace(" ", SPACE)
        if self.joins.issuperset(map(add, marked, marked[1:])):
            ids = self._part(marked)
        else:
            cuts = [0, *(i for i in range(1, len(text)) if marked[i - 1 : i + 1] not in self.joins), len(text)]
            ids = [int(x) for a, b in zip(cuts, cuts[1:], strict=False) for x in self.known[text[a:b]].split()]
        out, back = " ".join(map(str, ids)), self._surface(ids)
        if back != text:
            out = _Odd(out)
            out.back = back
        return out

    def begun(self, text: str) -> str:
        """The text as it is cut into units."""
        return " " + text if text and self.prefix else text

    def encode(self, text: str, end: bool = True) -> list[int]:
        return [int(x) for u in self.units(self.begun(text)) for x in self.known[u].split()] + [self.eos] * end

    def _surface(self, ids: list[int]) -> str:
        """Text of ids, leading blank included; runs of byte tokens are decoded together."""
        if self.byte_ids.isdisjoint(ids):
            return "".join([self.surfaces[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(self._bytes(run))
                run = bytearray()
            out.append(self.surfaces[i])
        return "".join(out) + self._bytes(run)

    @staticmethod
    def _bytes(run: bytearray) -> str:
        """Whole characters; each byte that belongs to none becomes U+FFFD."""
        out, at = [], 0
        while True:
            try:
                return "".join(out) + run[at:].decode()
            except UnicodeDecodeError as e:
                out.append(run[at : at + e.start].decode() + "�")
                at += e.start + 1

    def decode(self, ids: list[int]) -> str:
        text = self._surface(ids)
        return text[1:] if self.prefix and text[:1] == " " else text

    def coded(self, text: str) -> tuple[str, str]:
        """The decimal ids with an end id, joined by blanks, and the text that they decode to."""
        units = self.units(self.begun(text))
        found = [*map(self.known.__getitem__, units)]
        back = "".join(units) if _Odd not in set(map(type, found)) else "".join([f.back if type(f) is _Odd else u for f, u in zip(found, units, strict=True)])
        ids = " ".join(found)
        return f"{ids} {self.eos}" if ids else str(self.eos), back[1:] if self.prefix and back[:1] == " " else back


_CODECS: dict[bytes, PieceCodec] = {}
KEPT.append(_CODECS)


def codec_of(model: bytes, remembered: int = REMEMBERED) -> PieceCodec:
    """This worker's codec of a model: what one task has learned of words serves the next."""
    digest = hashlib.sha256(model).digest()
    if digest not in _CODECS or _CODECS[digest].known.limit != remembered:
        _CODECS.clear()
        _CODECS[digest] = PieceCodec(model, remembered)
    return _CODECS[digest]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, lean: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): every whole text encoded, with an end id, and decoded.

    The model (its size does not depend on the data) is sent to the workers once. A null text is empty: one end id.
    Rows stay rows, repeated and null ids included; an empty table gives an empty result; other columns are ignored.
    A lean worker learns less and forgets it with the task, at the cost of time: else every worker that earlier stages
    have left and that gets a task would go on holding a codec.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lean:
            forgotten()
        codec = codec_of(model.value, REMEMBERED // 4 if lean else REMEMBERED)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                n, hashes, backs, ids_out = [], [], [], []
                for t in b.column(1).to_pylist():
                    ids, back = codec.coded(t or "")
                    n.append(ids.count(" ") + 1)
                    hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                    backs.append(hashlib.sha256(back.encode()).hexdigest())
                    if keep_ids:
                        ids_out.append(np.fromstring(ids, np.int32, sep=" "))
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(backs, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids_out, pa.list_(pa.int32()))] * keep_ids, names)
        del codec
        (forgotten if lean else trimmed)()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op9_piece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

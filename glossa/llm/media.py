"""Interleaved document sequences and media columns.

HTML is parsed into one ordered list of text and media-reference structs; media references carry the digest of
their payload, the payload store is keyed by digest, and a join on it resolves each reference once per digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import by_place, text_key, utf8

#: 64 pixels of 3 samples: payloads fill whole rows of an RGB image.
ROW_BYTES = 192
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
ARROW_SEQUENCE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


class _Sequence(HTMLParser):
    """Text and <img>/<audio>/<video> in document order; the caption is a figure's figcaption, else the alt text."""

    MEDIA = ("img", "audio", "video", "source")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.figure: list[int] | None = None
        self.figcaption: str | None = None
        self.caption: list[str] | None = None
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.figure, self.figcaption = [], None
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.MEDIA and a.get("src"):
            src = a["src"]
            digest = src[7:] if src.startswith("sha256:") else hashlib.sha256(src.encode()).hexdigest()
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append({"kind": "media", "text": None, "digest": digest, "caption": self.figcaption or a.get("alt")})

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure or []:
                self.items[i]["caption"] = text
            if self.figure is not None:
                self.figcaption = text
            self.caption = None
        elif tag == "figure":
            self.figure, self.figcaption = None, None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.caption is not None:
            self.caption.append(data)
        elif data.strip():
            if self.items and self.items[-1]["kind"] == "text":
                self.items[-1]["text"] += data
            else:
                self.items.append({"kind": "text", "text": data, "digest": None, "caption": None})


def sequence(page: str | None) -> list[dict]:
    """The ordered structs of one page; null and empty pages have none."""
    p = _Sequence()
    p.feed(page or "")
    p.close()
    return [{"position": i, **x} for i, x in enumerate(p.items)]


def apart(names: list[str], taken: list[str]) -> list[str]:
    """The names of a page's columns; those that are taken begin with `page_`."""
    out: list[str] = []
    for name in names:
        while name in taken or name in out:
            name = f"page_{name}"
        out.append(name)
    return out


def sequences(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages with their sequence instead of their HTML, at the end; all other columns stay, one that is itself called
    `sequence` as `page_sequence`. Null and empty pages have an empty sequence; repeated pages keep their rows."""
    others = [c for c in pages.columns if c != html_col]
    rows = pages.select(*[F.col(f"`{c}`") for c in [*others, html_col]])
    names = apart(others, ["sequence"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([sequence(x) for x in b.column(b.num_columns - 1).to_pylist()], ARROW_SEQUENCE)], [*names, "sequence"])

    kinds = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, rows.schema.fields, strict=False)]
    return by_place(rows).mapInArrow(run, ", ".join([*kinds, f"sequence {SEQUENCE}"]))


def resolve(seqs: DataFrame, resolved: DataFrame) -> DataFrame:
    """A row per media reference, with the columns of its page, where it stands, how much text comes before and after
    it, and what is known of its payload, joined on digest; unknown digests stay, with nulls. Page columns whose names
    the result has uses for come out with `page_` before them. resolved has a row per digest."""
    pages = [c for c in seqs.columns if c != "sequence"]
    names = apart(pages, ["position", "caption", "chars_before", "chars_after", "sequence", "s", *resolved.columns])
    seqs = seqs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(pages, names, strict=True)], "sequence")
    chars = lambda test: F.aggregate(F.filter("sequence", test), F.lit(0), lambda n, x: n + F.coalesce(F.length(x["text"]), F.lit(0)))
    kept = [F.col(f"`{n}`") for n in names]
    at = seqs.select(*kept, "sequence", F.explode(F.filter("sequence", lambda x: x["kind"] == "media")).alias("s"))
    position = F.col("s.position")
    refs = at.select(*kept, position, F.col("s.caption"), F.col("s.digest"), chars(lambda x: x["position"] < position).alias("chars_before"), chars(lambda x: x["position"] > position).alias("chars_after"))
    return refs.join(resolved, "digest", "left")


def interleaved(seqs: DataFrame, key: str, resolved: DataFrame) -> DataFrame:
    """(key, items): each page's sequence in order, its texts as they were and its media references with what is known
    of their payloads in `media`. Keys must be unique; pages without any item have an empty array."""
    items = seqs.select(key, F.explode("sequence").alias("s")).select(key, "s.*")
    known = resolved.select(F.col("digest").alias("_digest"), F.struct(*resolved.columns).alias("media"))
    met = items.where("kind = 'media'").join(known, F.col("digest") == F.col("_digest"), "left").drop("_digest").unionByName(items.where("kind <> 'media'"), allowMissingColumns=True)
    lists = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "kind", "text", "digest", "caption", "media"))).alias("items"))
    return seqs.select(key).join(lists, key, "left").withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))


def to_png(payload: bytes, width: int = ROW_BYTES // 3) -> bytes:
    """An 8-bit RGB PNG whose samples are the payload, row by row; its length must be a multiple of a row."""
    row = width * 3
    rows = np.frombuffer(payload, np.uint8).reshape(-1, row)
    raw = np.zeros((len(rows), row + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 2, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples (rows x width x 3) of a PNG that to_png wrote; checks every chunk."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] * 3 + 1)
    return raw[:, 1:].reshape(shape[1], shape[0], 3)


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW_BYTES if text else ROW_BYTES)


def feature(samples: np.ndarray) -> str:
    """Height, mean, deviation and entropy of the samples, rounded."""
    flat = samples.reshape(-1)
    p = np.bincount(flat, minlength=256) / flat.size
    p = p[p > 0]
    return f"h={samples.shape[0]};mean={flat.mean(dtype=np.float64):.4f};std={flat.std(dtype=np.float64):.4f};entropy={-(p * np.log2(p)).sum():.4f}"


def media_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media): the padded text of every row as a PNG, once per distinct payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                seen = {}
                for k, text in zip(b.column(0)[at : at + 256].to_pylist(), b.column(1)[at : at + 256].to_pylist(), strict=True):
                    if k not in seen:
                        seen[k] = (hashlib.sha256(padded(text)).hexdigest(), to_png(padded(text)))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in seen.values()], pa.string()), pa.array([m for _, m in seen.values()], pa.binary())], ["digest", "media"])

    rows = docs.select(text_key(text_col).alias("key"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, "digest string, media binary").groupBy("digest").agg(F.max("media").alias("media"))


def described(store: DataFrame) -> DataFrame:
    """Read every stored medium back: what its payload is and its features, a row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for want, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                samples = from_png(media)
                payload = samples.tobytes()
                if (got := hashlib.sha256(payload).hexdigest()) != want:
                    raise ValueError("the stored payload has another digest than its reference")
                out.append((want, len(payload), got, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return store.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def wrapped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, html): each document as a page, the first half of its text, a figure that refers to the
    document's payload by digest, and the second half."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n, half = F.octet_length(text).cast("long"), F.floor(F.length(text) / 2).cast("int")
    blanks = F.when(n == 0, F.lit(ROW_BYTES)).otherwise(F.pmod(-n, F.lit(ROW_BYTES))).cast("int")
    digest = F.sha2(F.concat(text, F.repeat(F.lit(" "), blanks)).cast("binary"), 256)
    marked = lambda part: F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(part, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), n.cast("string"), F.lit(" bytes of text</figcaption></figure>"))
    return docs.select(F.col(id_col).alias("doc_id"), n.alias("n_bytes"), F.concat(marked(F.substring(text, F.lit(1), half)), figure, marked(F.substring(text, half + 1, F.length(text)))).alias("html"))


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored losslessly as an image, referred to from the middle of its page, resolved by digest and read
    back: (digest, doc_id, n_bytes, position, caption, chars_before, chars_after, payload and medium).

    A null text is empty (one row of blanks); equal texts share one stored medium, which is read back once however
    many rows refer to it; repeated and null ids keep their rows; a text is one medium however long; halves that are
    only white space are no items of the page; an empty table gives an empty result; other columns are ignored.
    """
    return resolve(sequences(wrapped(docs, id_col, text_col)), described(media_store(docs, text_col)))


def op8_interleaved_media(spark, sf_dir: str) -> DataFrame:
    out = documents_as_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "chars_before", "chars_after")

"""WARC archives: pages written as one gzip stream per archive, then normalised to a gzip member per record.

Archives live as rows (archive, content) of tables in the shared folder, so any store that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored, utf8

#: Payloads below this size are never replaced by a revisit record.
MIN_REVISIT_BYTES = 100
GZIP = 31
#: The table has no dates of fetching; callers that have one pass it.
NO_DATE = "1970-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a URI that stay as they are.
URI_MARKS = ":/?#[]@!$&'()*+,;=%-._~"
#: Parts that the rows of one digest are dealt to.
SALTS = 16
PIECE = 1 << 20


def page_uri(page_id: object) -> str:
    """A record id of a page id of any type; the null id has one of its own."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(uri: str | None) -> str | None:
    """The page id, as text, of a record id."""
    return None if uri is None or uri == "<urn:page>" else unquote(uri[10:-1])


def record(kind: str, page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str = NO_DATE) -> bytes:
    """One WARC/1.1 record of an HTTP answer; a revisit's block holds the answer's header only, as the standard has it,
    and names the response it repeats."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = answer + payload if kind == "response" else answer
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    head.append("WARC-Target-URI: " + ("".join(quote(url, safe=URI_MARKS).split()) if url else page_uri(page_id)[1:-1]))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {page_uri(refers_to)}", f"WARC-Profile: {IDENTICAL}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def answer_of(body: bytes) -> tuple[int, bytes]:
    """Of an HTTP answer, the payload's length as its header says and the payload itself, absent in a revisit."""
    head, _, payload = body.partition(b"\r\n\r\n")
    return next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), payload


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of WARC bytes into records, holding one record and one piece at a time."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x[15:]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held or need:
        raise ValueError("the archive ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def inflate(content: bytes) -> Iterator[bytes]:
    """Every gzip member of a file, in pieces of bounded size."""
    while content:
        d = zlib.decompressobj(GZIP)
        data = content
        while data and not d.eof:
            yield d.decompress(data, PIECE)
            data = d.unconsumed_tail
        while tail := d.decompress(d.unconsumed_tail, PIECE):
            yield tail
        if not d.eof:
            raise ValueError("the gzip stream is cut short")
        content = d.unused_data


def normalise(content: bytes) -> tuple[bytes, list[tuple[int, int, str, str]]]:
    """Inflate a whole-file stream once; each record becomes a member of its own. Index: offset, length, id, type."""
    out, index = bytearray(), []
    for raw in records_of(inflate(content)):
        c = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        member = c.compress(raw) + c.flush()
        fields, _ = parse(raw)
        index.append((len(out), len(member), fields["WARC-Record-ID"], fields["WARC-Type"]))
        out += member
    return bytes(out), index


def classified(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to). Null html is an empty payload.

    Rows that repeat the smallest page_id of a digest are all responses; null ids are never referred to, and are
    responses when no other id has their payload. Copies of one payload are dealt to SALTS parts by their ids; what
    meets them there is a digest and an id. Payloads too small for a revisit are dealt by their ids alone.
    """
    large = F.octet_length("payload") >= min_revisit
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    base = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("met", F.when(large, F.col("digest")).otherwise(F.xxhash64("page_id").cast("string"))).withColumn("salt", salt)
    first = pages.select("page_id", utf8("html").alias("payload")).where(large).groupBy(F.sha2("payload", 256).alias("met")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    spread = first.select("met", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    again = F.col("first_id").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return base.join(spread, ["met", "salt"], "left").select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def write_monolithic(rows: DataFrame, archive_bytes: int) -> DataFrame:
    """(archive, content): classified rows packed where they are, each archive a single gzip stream that ends with
    the record that takes it past archive_bytes. No exchange of its own; a retried task packs its own rows again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, size = TaskContext.get().partitionId(), 0, 0
        c, parts = zlib.compressobj(6, zlib.DEFLATED, GZIP), []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([f"{part}-{at}"], pa.string()), pa.array([b"".join(parts) + c.flush()], pa.binary())], ["archive", "content"])
        for b in batches:
            for i in range(b.num_rows):
                x = {n: v[0].as_py() for n, v in zip(b.schema.names, b.slice(i, 1).columns, strict=True)}
                raw = record(x["record_type"], x["page_id"], x["url"], x["payload"], x["digest"], x["refers_to"])
                parts.append(c.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield done()
                    c, parts, at, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), [], at + 1, 0
        if size:
            yield done()

    return rows.mapInArrow(pack, "archive string, content binary")


def normalised(archives: DataFrame) -> DataFrame:
    """(archive, content, index): a member per record and the sidecar index of offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]))
        for b in batches:
            for at, content in zip(b["archive"].to_pylist(), b["content"].to_pylist(), strict=True):
                out, index = normalise(content)
                index = [dict(zip(("offset", "length", "record_id", "record_type"), x, strict=True)) for x in index]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([out], pa.binary()), pa.array([index], kind)], ["archive", "content", "index"])

    return archives.mapInArrow(run, "archive string, content binary, index array<struct<offset:long,length:long,record_id:string,record_type:string>>")


def read_members(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """A row per record, each read by its own slice of the archive as the sidecar index says; a response's digest is
    taken anew from the payload read, a revisit's from its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in batches:
            for content, index in zip(b["content"].to_pylist(), b["index"].to_pylist(), strict=True):
                out = []
                for e in index:
                    fields, body = parse(zlib.decompress(content[e["offset"] : e["offset"] + e["length"]], GZIP))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size, payload = answer_of(body)
                    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"record {fields['WARC-Record-ID']} has another payload than its header says")
                    out.append((page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    read = archives.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def normalise_archives(pages: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """Write pages to single-stream archives of about archive_bytes, normalise them, read every record back.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to), a row per page row. Ids are of any type
    that text can hold and give back (numbers, strings); they should be a key: rows that repeat one get records that
    repeat its record id. An empty table gives an empty result; null html is an empty payload; a page without url is
    its own target; equal payloads go by the smallest id; a very long page makes its archive as long; clashing extra
    columns are ignored.
    """
    mono = stored(write_monolithic(classified(pages), archive_bytes), "warc-mono")
    return read_members(stored(normalised(mono), "warc-members"), pages.schema["page_id"].dataType.simpleString())


def op6_warc_normaliser(spark, sf_dir: str) -> DataFrame:
    return normalise_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
"""

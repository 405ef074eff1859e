"""WARC derivative builder: response records into linked metadata and conversion records.

Each response gives a `metadata` record (application/warc-fields: what the response was, with its source headers and
digests) and a `conversion` record (text/plain: the text the page shows). Both refer to the response by WARC-Refers-To,
keep its target URI and date, and carry its headers, as they came and in their order, and its digests; their own ids follow
from the response's, so that a repeated task makes equal records. In a file these headers stand as extension fields
`X-Source-...`. Digests are those of the archive where it has them, else of the payload's bytes. Text is decoded by the
response's character set, or the page's own, or as UTF-8.

Defined results: a response without a payload (null) counts as an empty one and gives an empty conversion block; null
URIs, dates and headers are left out of the written header, line breaks in values become spaces. Responses with equal ids
give records with equal ids. A record of another type gives nothing. Payloads of any length are converted whole, bytes that
are no characters of the set become U+FFFD. Other columns, whatever their names, are not carried. Archives are read record
by record from their bytes, of which Spark holds a file in one row: files of 2 GB at most. An empty table gives an empty
table.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._common import slices
from weftgraph.llm.html_extract import plain_text

FIELDS = "array<struct<name:string,value:string>>"
RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    f"content_length bigint, block_digest string, headers {FIELDS}, block string"
)
_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_ARROW = pa.schema(
    [(x, pa.string()) for x in ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type")]
    + [("content_length", pa.int64()), ("block_digest", pa.string()), ("headers", _FIELDS), ("block", pa.string())]
)
RESPONSE = f"key string, record_type string, record_id string, target_uri string, date string, headers {FIELDS}, payload binary, payload_digest string, source_digest string"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
_BREAKS = re.compile(r"[\x00-\x1f\x7f]+")
_CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([\w:.-]+)""", re.I)
#: Bytes of a compressed archive that are inflated at a time, and of payloads in a batch.
READ, BATCH = 1 << 16, 8 << 20


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {source}')}>"


def responses_of(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: Column | None = None) -> DataFrame:
    """Response records of a table of pages: the ids follow from key and URL."""
    key, url, html = (F.col(f"`{c}`") for c in (key, url, html))
    digits = F.md5(F.concat_ws(" ", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        key.alias("key"),
        F.lit("response").alias("record_type"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        url.alias("target_uri"),
        (date if date is not None else F.lit("1970-01-01T00:00:00Z")).cast("string").alias("date"),
        F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value"))).alias("headers"),
        html.cast("binary").alias("payload"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.lit(None).cast("string").alias("source_digest"),
    )


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    """The text of a payload, by the character set of its headers, of its first kilobyte, or UTF-8."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    found = _CHARSET.search(kind.encode("utf-8", "replace")) or _CHARSET.search(payload[:1024])
    name = found[1].decode("ascii", "replace") if found else "utf-8"
    try:
        codecs.lookup(name)
        return payload.decode(name, "replace").encode("utf-8", "replace").decode()
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace")


def content(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """A payload without its content coding, if that is known and whole."""
    coding = ",".join(v.lower() for k, v in headers if k.lower() == "content-encoding").replace(" ", "")
    try:
        if coding in ("gzip", "x-gzip"):
            return zlib.decompress(payload, 31)
        if coding == "deflate":
            return zlib.decompress(payload, 15 if payload[:1] == b"\x78" else -15)
    except zlib.error:
        pass
    return payload


def unchunked(body: bytes) -> bytes:
    """The body of a chunked message; what is not in chunks is kept as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            return b"".join(out) if out and at >= len(body) else body if not out else b"".join([*out, body[at:]])
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response (the columns of RESPONSE, a payload of text or bytes), with its key."""
    kind = responses.schema["key"].dataType.simpleString()
    rows = responses.filter(F.col("record_type") == "response")
    rows = rows.select("key", "record_id", "target_uri", "date", "headers", F.col("payload").cast("binary").alias("payload"), "payload_digest", "source_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20, "payload"):
            out, keys = [], []
            for i, (record, uri, date, headers, payload, known, whole) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                raw = payload or b""
                headers = [(h["name"], h["value"]) for h in headers or [] if h and h["name"] and h["value"] is not None]
                kept = [("payload-digest", known or digest(raw)), *([("block-digest", whole)] if whole else []), *[(f"header-{k}", v) for k, v in headers]]
                text = plain_text(decoded(content(raw, headers), headers))
                fields = [("source-type", "response"), ("source-length", str(len(raw))), *[(f"source-{k}", v) for k, v in kept], ("text-length", str(len(text)))]
                block = "".join(f"{_line(k)}: {_line(v)}\r\n" for k, v in fields)
                for what, type_, body in (("metadata", "application/warc-fields", block), ("conversion", "text/plain; charset=utf-8", text)):
                    own = body.encode()
                    keys.append(i)
                    out.append((what, derived_id(what, record or ""), record, uri, date, type_, len(own), digest(own), [{"name": k, "value": v} for k, v in kept], body))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *columns], names=["key", *_ARROW.names])

    return rows.mapInArrow(run, f"key {kind}, {RECORD}")


def _line(value: str) -> str:
    """A value on one line."""
    return _BREAKS.sub(" ", value).strip()


def record_bytes(record: dict) -> bytes:
    """A record as it stands in a WARC/1.1 file; what it keeps of its source stands as X-Source- fields."""
    body = (record["block"] or "").encode()
    head = [
        ("WARC-Type", record["record_type"]),
        ("WARC-Record-ID", record["record_id"]),
        ("WARC-Refers-To", record["refers_to"]),
        ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Date", record["date"]),
        ("WARC-Block-Digest", digest(body)),
        ("Content-Type", record["content_type"]),
        *[("X-Source-" + "-".join(x[:1].upper() + x[1:] for x in f["name"].split("-")), f["value"]) for f in record.get("headers") or []],
        ("Content-Length", str(len(body))),
    ]
    return "".join(["WARC/1.1\r\n", *[f"{_line(k)}: {_line(v)}\r\n" for k, v in head if v is not None], "\r\n"]).encode() + body + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzip members, one in each row of a table; concatenated in any order they are a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20, "block"):
            rows = batch.to_pylist()
            made = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array([z.compress(record_bytes(r)) + z.flush() for z, r in zip(made, rows, strict=True)], pa.binary())], names=["member"])

    records.mapInArrow(run, "member binary").write.parquet(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, plain or of gzip members, by pieces; a member that is cut off ends it."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(view), READ):
            yield bytes(view[at : at + READ])
        return
    at = 0
    while at < len(view) and bytes(view[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while at < len(view) and not member.eof:
            piece = view[at : at + READ]
            try:
                out = member.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(member.unused_data)
            if out:
                yield out


def parse_warc(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of the records in a WARC file, headers in order; only a record is held besides the file. A cut-off
    last record is left out."""
    held, pieces = bytearray(), _inflated(data)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (start := held.find(b"WARC/1.")) < 0:
            del held[: max(0, len(held) - 6)]
            if not more():
                return
        del held[:start]
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
        size = next((v for k, v in headers if k.lower() == "content-length"), "0")
        size = int(size) if size.isdigit() else 0
        while len(held) < end + 4 + size:
            if not more():
                return
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def response_of(headers: list[tuple[str, str]], block: bytes) -> dict | None:
    """A row of RESPONSE, if a record is a response."""
    own = {k.lower(): v for k, v in reversed(headers)}
    if own.get("warc-type", "").lower() != "response":
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]) if k.strip()]
    if any(k.lower() == "transfer-encoding" and "chunked" in v.lower() for k, v in fields):
        body = unchunked(body)
    return {
        "key": own.get("warc-record-id"),
        "record_type": "response",
        "record_id": own.get("warc-record-id"),
        "target_uri": own.get("warc-target-uri"),
        "date": own.get("warc-date"),
        "headers": [{"name": k, "value": v} for k, v in fields],
        "payload": body,
        "payload_digest": own.get("warc-payload-digest"),
        "source_digest": own.get("warc-block-digest"),
    }


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, as `derive` takes them; a task reads a file's records one after another."""
    kinds = pa.schema(
        [(x, pa.string()) for x in ("key", "record_type", "record_id", "target_uri", "date")]
        + [("headers", _FIELDS), ("payload", pa.binary()), ("payload_digest", pa.string()), ("source_digest", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for record in parse_warc(data.as_py()):
                    if (row := response_of(*record)) is not None:
                        rows.append(row)
                        size += len(row["payload"])
                        if size >= BATCH:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RESPONSE)


def derivatives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Metadata and conversion records of a table of pages, with its key."""
    out = derive(responses_of(pages, key, url, html))
    return out.select(F.col("key").alias(key), *[c for c in out.columns if c != "key"])

"""WARC archives of pages: segmented records out, reassembled records back in.

Method. Each page is one response record, or a revisit of the page with the
same payload and the smallest id. A response's block is an HTTP message in
chunked transfer coding; a block above ``segment_bytes`` is written as a first
segment and continuation records. Reading back groups continuations by their
origin id, orders them by segment number, verifies numbers and total length,
decodes the chunks and checks the payload digest.

Archives. A record ends with two line breaks, so Spark's text sink with that
line separator writes valid archives: its commit protocol drops the files of
lost attempts, and any file system that Spark writes will do. Files are
bounded by a record count. They are read with Spark's ``binaryFile`` source
and walked by Content-Length.

Skew. Payloads are never shuffled to find copies: only (digest, length,
page_id) is, reduced map-side. The table of copied digests joins the pages;
Spark broadcasts it only under its size threshold and splits a hot digest
otherwise. Only segments are shuffled to be reassembled, one page a group.

Edge cases. A null payload is empty; a null url is an empty target. Pages with
the same id and payload are all responses if that id is the smallest. Null ids
are written without an id and read back as null; payload copies whose ids are
all null are all responses. An empty table gives no record and no row. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.session import scratch_root, stage
from workloads.base import Registry, Tables

R = Registry()

RECORD_END = b"\r\n\r\n"
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 2000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer coding."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; trailers and chunk extensions are allowed."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message, chunks decoded."""
    head, _, body = block.partition(RECORD_END)
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records(page_id, url: str, payload: bytes, uid: int, refers, date: str, segment_bytes: int) -> Iterator[bytes]:
    """A page's records, each without the two line breaks that end it.

    ``refers`` is None for a response, else a one-element tuple with the id of the page it repeats.
    """
    name = lambda n: f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{uid}/{page_id}/{n}'.encode()).digest(), version=4)}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    mime = "application/http;msgtype=response"
    fields = [("WARC-Date", date), ("WARC-Target-URI", target), ("Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", mime)]
    if refers is not None:
        same = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        more = [("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), ("WARC-Profile", same), ("Refers-To-Page-ID", refers[0]), ("Payload-Length", len(payload))]
        yield _record([*more, *fields], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *fields], block)
        return
    for n, part in enumerate(parts, 1):
        total = len(block) if n == len(parts) else None
        numbers = [("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
        if n == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *fields, *numbers], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(n)), ("WARC-Segment-Origin-ID", name(1)), *fields[:2], *numbers], part)


def _write(batches: Iterator[pa.RecordBatch], date: str, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, size = [], 0
        columns = [batch[k].to_pylist() for k in ("page_id", "url", "html", "uid", "least")]
        for page, url, html, uid, least in zip(*columns, strict=True):
            refers = None if least is None or least == page else (least,)
            for r in records(page, url or "", (html or "").encode(), uid, refers, date, segment_bytes):
                made.append(r)
                size += len(r)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                made, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``."""
    html = F.coalesce("html", F.lit(""))
    facts = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    copies = facts.groupBy("sha", "size").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copies = stage(copies.select("sha", "size", "least"), "copies")
    rows = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    rows = rows.join(copies, ["sha", "size"], "left").withColumn("uid", F.monotonically_increasing_id())
    made = rows.select("page_id", "url", "html", "uid", "least").mapInArrow(partial(_write, date=date, segment_bytes=segment_bytes), "record binary")
    sink = made.select(F.col("record").cast("string").alias("value")).write
    sink.option("lineSep", RECORD_END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def walk(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of an archive's records; field names are in lower case."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        end = archive.index(RECORD_END, at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if archive[stop : stop + 4] != RECORD_END:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, bytes(view[start:stop])
        at = stop + 4


_PARSED = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, origin string, segment bigint, total bigint, block binary"
_PARSED_ARROW = pa.schema(
    [(k, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for k, t in (x.split() for x in _PARSED.split(", "))]
)


def _checked(payload: bytes, stated: str) -> str:
    own = digest(payload)
    if stated != f"sha1:{own}":
        raise ValueError(f"payload digest {own} is not the stated {stated}")
    return own


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for f, block in walk(content.as_py()):
                page, kind = f.get("page-id"), f["warc-type"]
                if "warc-segment-number" in f:
                    total = f.get("warc-segment-total-length")
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    rows.append((page, None, f.get("warc-payload-digest"), kind, None, origin, int(f["warc-segment-number"]), total and int(total), block))
                elif kind == "revisit":
                    rows.append((page, int(f["payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), kind, f.get("refers-to-page-id"), None, None, None, None))
                else:
                    payload = payload_of(block)
                    rows.append((page, len(payload), _checked(payload, f["warc-payload-digest"]), kind, None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARSED_ARROW.types, strict=True)], schema=_PARSED_ARROW)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_PARSED_ARROW][:5])
    for batch in batches:
        rows = []
        for page, stated, total, parts in zip(*[batch[k].to_pylist() for k in ("page_id", "stated", "total", "parts")], strict=True):
            block = b"".join(p["block"] for p in parts)
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                raise ValueError(f"page {page}: segments are missing or their length is not {total}")
            payload = payload_of(block)
            rows.append((page, len(payload), _checked(payload, stated), "response", None))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def read_archives(spark, path: str, page_type: str = "bigint") -> DataFrame:
    """One row per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = stage(files.mapInArrow(_parse, _PARSED), "records")
    final = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = parsed.filter("segment is null").select(*final)
    parts = parsed.filter("segment is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"),
        F.max("payload_digest").alias("stated"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    rebuilt = parts.mapInArrow(_assemble, ", ".join(_PARSED.split(", ")[:5]))
    out = whole.unionByName(rebuilt)
    return out.withColumn("page_id", F.col("page_id").cast(page_type)).withColumn("refers_to", F.col("refers_to").cast(page_type))


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, strlen(html)::bigint payload_bytes, sha1(html) h, (unhex(sha1(html)))::bit::varchar b, min(page_id) over (partition by html) least from p)
select page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * (b[i * 5 + 1])::int + 8 * (b[i * 5 + 2])::int + 4 * (b[i * 5 + 3])::int + 2 * (b[i * 5 + 4])::int + (b[i * 5 + 5])::int, 1) for i in range(32)], '') payload_digest,
  case when page_id = least then 'response' else 'revisit' end record_type,
  case when page_id <> least then least end refers_to
from s
"""


@R.add(SQL)
def op5_warc(t: Tables) -> DataFrame:
    """All pages written to archives and read back."""
    path = f"{scratch_root(t.spark)}/warc-{uuid.uuid4().hex}"
    write_archives(t.pages, path)
    return read_archives(t.spark, path)

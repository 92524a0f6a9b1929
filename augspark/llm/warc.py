"""WARC archives: a writer with revisit records, and a reader that salvages what follows damaged bytes.

The reader checks every record (version line, headers, length, digests, end mark). Where a check fails it
searches for the next gzip member or version line that starts a valid record, goes on there, and reports
the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from augspark.session import cut_lineage

# Payloads from this length on are stored once
REVISIT_BYTES = 1000
# An archive file ends after this many records or with its Spark partition
FILE_RECORDS = 50_000
ID_PREFIX = "urn:augspark:page:"
DATE = "2000-01-01T00:00:00Z"
# Fixed value: a gzip member without content. Spark's text writer puts it behind every record
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
# Fixed value: the profile that the format names for revisits of equal payloads
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes that are unpacked at a time: what a member leaves over is copied
_PIECE = 1 << 14
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with HTTP headers only."""
    block = _HTTP.format(len(payload)).encode()
    if not is_revisit:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'null' if key is None else key}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        target = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
        lines.append(f"WARC-Target-URI: {target}")
    if is_revisit:
        lines += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member without a time stamp, so that equal records have equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Found:
    """A record, or a gap (``reason`` says which check failed first), at ``offset`` of a file."""

    offset: int
    length: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        """What stands behind the HTTP headers, or the block if it has none."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


class BadRecord(Exception):
    pass


def parse_record(data: bytes, at: int) -> tuple[Found, int]:
    """The plain record at ``at`` and the place behind it."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise BadRecord("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise BadRecord("headers do not end")
    headers: dict[str, str] = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord("bad header line")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise BadRecord("no length")
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise BadRecord("a required header is missing")
    stop = end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise BadRecord("length and end mark disagree")
    found = Found(at, stop + 4 - at, None, headers, data[end + 4 : stop])
    _check_digest(headers.get("warc-block-digest"), found.block, "block digest")
    if headers["warc-type"] == "response":
        _check_digest(headers.get("warc-payload-digest"), found.payload, "payload digest")
    return found, stop + 4


def _check_digest(stated: str | None, data: bytes, what: str) -> None:
    name, _, value = (stated or "").partition(":")
    if name.lower() != "sha1":
        return
    raw = hashlib.sha1(data)
    import base64

    if value.lower() != raw.hexdigest() and value.upper() != base64.b32encode(raw.digest()).decode():
        raise BadRecord(what)


def _read_at(data: bytes, at: int) -> tuple[Found | None, int]:
    """The record at ``at``, plain or in a gzip member (None for an empty member), and the place behind it."""
    if data[at : at + 2] != b"\x1f\x8b":
        return parse_record(data, at)
    unpacker = zlib.decompressobj(31)
    parts, behind = [], at
    try:
        while not unpacker.eof and behind < len(data):
            step = data[behind : behind + _PIECE]
            parts.append(unpacker.decompress(step))
            behind += len(step)
    except zlib.error as e:
        raise BadRecord("bad gzip member") from e
    if not unpacker.eof:
        raise BadRecord("gzip member does not end")
    behind -= len(unpacker.unused_data)
    inner = b"".join(parts)
    if not inner:
        return None, behind
    found, used = parse_record(inner, 0)
    if inner[used:].strip(b"\r\n"):
        raise BadRecord("more than a record in a member")
    return Found(at, behind - at, None, found.headers, found.block), behind


def salvage(data: bytes) -> Iterator[Found]:
    """All records of a file that pass their checks, and the gaps between them, in order."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        if gap is None and data[at] in b"\r\n":
            at += 1
            continue
        try:
            found, behind = _read_at(data, at)
        except BadRecord as e:
            if gap is None:
                gap, reason = at, str(e)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield Found(gap, at - gap, reason)
            gap = None
        if found is not None:
            yield found
        at = behind
    if gap is not None:
        yield Found(gap, len(data) - gap, reason)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives with a gzip member per row under ``path``; columns beside the three are not written.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes, those with the largest key are
    responses (a null key is smaller than any other) and the others revisits of it. Shorter payloads are
    always responses. Null payloads count as empty. Keys are whole numbers.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    marked = rows.withColumn("digest", F.sha1("payload"))
    # short rows only: a payload is not shuffled to find out who has the same
    long = cut_lineage(marked.where(F.octet_length("payload") >= revisit_bytes).select("key", "digest"))
    shared = long.groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = long.join(shared, "digest").where("not (key <=> first)").select(
        F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")
    )
    again = again.distinct()
    joined = marked.join(again, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    wanted = joined.select("key", "url", "payload", "digest", "refers_to", F.col("_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                columns = (c.to_pylist() for c in part.columns)
                out = [member(record_bytes(*values)) for values in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = wanted.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # the text writer copies the bytes of a value as they are
    writer = records.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record and per gap of all files under ``path``, gzipped by record or plain.

    Columns: path, offset, length, gap_reason (null for records), record_type, record_id, target_uri,
    refers_to, stated_digest, payload_bytes, payload_digest (hex SHA-1 of the payload read) and, on
    request, payload. A file is read by one task; files have at most 2 GB.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["path", "offset", "length", "gap_reason", "record_type", "record_id", "target_uri", "refers_to", "stated_digest", "payload_bytes", "payload_digest"]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string()]
    schema = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in zip(names, types, strict=True))
    if with_payload:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], schema + ", payload binary"

    def rows(where: str, content: bytes) -> Iterator[list]:
        for f in salvage(content):
            h = f.headers
            plain = [where, f.offset, f.length, f.reason]
            if f.reason is not None:
                yield [*plain, *[None] * (len(names) - 4)]
                continue
            payload = f.payload
            about = [h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest")]
            yield [*plain, *about, len(payload), hashlib.sha1(payload).hexdigest(), *[payload] * with_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                held: list[list] = []
                for row in rows(where.as_py(), content.as_py()):
                    held.append(row)
                    if len(held) == 2000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    def _batch(held: list[list]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Records as (key, payload_bytes, payload_digest, record_type, refers_to), revisits with the facts of what they refer to.

    A revisit whose response was lost keeps its stated digest and has no length.
    """
    number = lambda c: F.regexp_extract(c, ID_PREFIX + r"(-?\d+)", 1)
    whole = cut_lineage(
        records.where("gap_reason is null").select(
            F.expr(f"try_cast({_sql_number('record_id')} as bigint)").alias("key"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            F.when(F.col("record_type") == "revisit", number("refers_to").cast("bigint")).alias("refers_to"),
            F.regexp_replace("stated_digest", "^sha1:", "").alias("stated"),
        )
    )
    # a record may have been written twice
    firsts = whole.where("record_type = 'response'").select(
        F.col("key").alias("_key"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
    ).distinct()
    is_revisit = F.col("record_type") == "revisit"
    joined = whole.where(is_revisit).join(firsts, (F.col("refers_to") == F.col("_key")) & (F.col("stated") == F.col("_digest")), "left")
    columns = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = joined.select("key", F.col("_bytes").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "record_type", "refers_to")
    return whole.where(~is_revisit).select(columns).unionByName(again)


def _sql_number(column: str) -> str:
    return f"nullif(regexp_extract({column}, '{ID_PREFIX}(-?[0-9]+)', 1), '')"

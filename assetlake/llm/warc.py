"""WARC archives: a writer, and a reader that salvages what damage leaves.

Writer. Every page is one record in a gzip member of its own. Pages with the same payload are one
``response`` (the largest id); the others are ``revisit`` records that refer to it and carry no payload.
Spark's own text writer writes the members to any file system, with its commit protocol: the last byte of a member
(the top byte of its length, zero below 16 MiB) is left to the line separator, and a longer record is cut
into several members. The files are plain ``.warc.gz`` content.

Reader. Archives are read with Spark's binary file source, so a file may have up to 2 GiB; the writer's
``RECORDS_PER_FILE`` keeps files far below. Each member is unpacked and checked (gzip's CRC and length, version line, header
block, content length, the end of the record, the payload's digest). After a failed check the reader looks for the next valid
gzip member or, in plain archives, the next version line, reads on from there and reports the bytes between as a gap.
A sound member that holds something else than one record (a whole archive packed at once, a broken record among others) is
searched like a plain archive: its records and gaps have ``inner_offset`` and ``inner_length`` in the unpacked
content; the first of them carries the member's place in the file.

Defined cases: null html is an empty payload; payloads are compared by SHA-1 and length; rows that share an id
and a payload are equal records, all responses if the id is the payload's largest; a null id is
never referred to unless all ids of the payload are null; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.llm.columns import store

RECORDS_PER_FILE = 2_000
_MEMBER_BYTES = 8 << 20
_FEED = 16_384
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")

RECORD_SCHEMA = (
    "path string, kind string, offset bigint, length bigint, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, headers map<string,string>, payload binary, "
    "payload_bytes bigint, inner_offset bigint, inner_length bigint"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_bytes(
    record_id: str, record_type: str, uri: str, digest: str, payload_bytes: int, payload: bytes | None, refers_to: str | None = None
) -> bytes:
    """One record: WARC header, HTTP header, payload (none for a revisit) and the end."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub('[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m.group(0).encode()), uri)}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(record: bytes) -> bytes:
    """The record in gzip members, the last byte of which is zero."""
    out = []
    for start in range(0, len(record), _MEMBER_BYTES):
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        out.append(packer.compress(record[start : start + _MEMBER_BYTES]) + packer.flush())
    return b"".join(out)


def page_urn(page_id: object) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def write_warc(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write (page_id, url, html) pages as archives below ``path``."""
    html = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", html.alias("html")).withColumn("sha1", F.unhex(F.sha1("html")))
    ids = pages.select("page_id", F.unhex(F.sha1(html)).alias("sha1"), F.octet_length(html).alias("bytes"))
    # Digests are few bytes: who answers for a payload is found on them alone, and a hot payload's rows stay where they are.
    first = ids.groupBy("sha1", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = store(first.select("sha1", "bytes", "first"), "responses")
    marked = marked.withColumn("bytes", F.octet_length("html"))
    owned = store(ids.distinct(), "ids").join(first, ["sha1", "bytes"]).where("not page_id <=> first")
    owned = owned.select(F.col("page_id").alias("own"), F.col("sha1").alias("own_sha1"), "first")
    same = F.col("page_id").eqNullSafe(F.col("own")) & (F.col("sha1") == F.col("own_sha1"))
    rows = marked.join(store(owned, "revisits"), same, "left").select(
        "page_id", "url", "sha1", "bytes", F.col("own_sha1").isNotNull().alias("again"), "first",
        F.when(F.col("own_sha1").isNull(), F.encode("html", "UTF-8")).alias("payload"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                out = []
                for page, url, sha1, size, again, owner, payload in zip(*(c.to_pylist() for c in batch.slice(low, 200).columns), strict=True):
                    digest = base64.b32encode(sha1).decode("ascii")
                    record = record_bytes(
                        page_urn(page), "revisit" if again else "response", url or "", digest, size,
                        None if again else payload, page_urn(owner) if again else None,
                    )
                    out.append(members(record)[:-1])
                yield pa.record_batch([pa.array(out, pa.binary())], names=["member"])

    packed = rows.mapInArrow(pack, "member binary")
    # A cast from binary keeps the bytes as they are, and the separator puts back the zero.
    lines = packed.select(F.col("member").cast("string").alias("value"))
    writer = lines.write.option("lineSep", "\x00").option("maxRecordsPerFile", records_per_file)
    writer.option("compression", "none").text(path)


@dataclass
class _Failed(Exception):
    reason: str


def _parse(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``start`` of unpacked data."""
    version = _VERSION.match(data, start)
    if version is None:
        raise _Failed("version line")
    close = data.find(b"\r\n\r\n", version.end() - 2)
    if close < 0:
        raise _Failed("header block")
    headers: dict[str, str] = {}
    for line in data[version.end() : close].split(b"\r\n"):
        if not line:
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Failed("header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise _Failed("content length")
    begin = close + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise _Failed("end of record")
    return headers, data[begin:end], end + 4


def _row(headers: dict[str, str], block: bytes, offset: int, length: int) -> dict:
    kind = headers.get("warc-type")
    payload, size = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise _Failed("HTTP header")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        size = int(stated.group(1)) if stated else len(payload)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit":
        if size != len(payload):
            raise _Failed("payload length")
        if digest and digest != sha1_base32(payload):
            raise _Failed("payload digest")
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    return {
        "kind": "record", "offset": offset, "length": length, "reason": None, "record_type": kind, "record_id": bare("warc-record-id"),
        "target_uri": headers.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload_digest": digest or None,
        "headers": headers, "payload": payload, "payload_bytes": size,
    }


def _gap(offset: int, length: int, reason: str) -> dict:
    return {"kind": "gap", "offset": offset, "length": length, "reason": reason}


def _member(data: bytes, start: int) -> tuple[bytes, int]:
    """The content and end of the gzip member at ``start``; its CRC and length are checked by zlib."""
    unpack, view, parts = zlib.decompressobj(31), memoryview(data), []
    try:
        while not unpack.eof and start < len(data):
            parts.append(unpack.decompress(view[start : start + _FEED]))
            start += _FEED
    except zlib.error as error:
        raise _Failed(f"gzip member: {error}") from None
    if not unpack.eof:
        raise _Failed("gzip member: cut off")
    return b"".join(parts), min(start, len(data)) - len(unpack.unused_data)


def _next_member(data: bytes, start: int) -> int:
    """Where the next gzip member begins whose content starts as a record does; the end of the data if there is none."""
    at = data.find(_GZIP, start)
    while at >= 0:
        try:
            if _VERSION.match(zlib.decompressobj(31).decompress(memoryview(data)[at : at + 4096], 64)):
                return at
        except zlib.error:
            pass
        at = data.find(_GZIP, at + 1)
    return len(data)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in order; their offsets and lengths cover it whole."""
    if data.startswith(_GZIP) or (not _VERSION.match(data) and _next_member(data, 0) < len(data)):
        yield from _salvage_members(data)
    else:
        yield from _salvage_plain(data)


def _salvage_members(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        content = b""
        try:
            content, end = _member(data, at)
            while True:  # a long record goes on in the next members
                try:
                    headers, block, close = _parse(content, 0)
                    break
                except _Failed as failed:
                    if failed.reason != "end of record" or end >= len(data):
                        raise
                    more, beyond = _member(data, end)
                    if _VERSION.match(more):
                        raise
                    content, end = content + more, beyond
            if close != len(content):
                raise _Failed("bytes after the record")
            rows = [_row(headers, block, at, end - at)]
        except _Failed as failed:
            rows = _inside(content, at, end) if content else []
            if not rows:
                end = _next_member(data, at + 1)
                rows = [_gap(at, end - at, failed.reason)]
        yield from rows
        at = end


def _inside(content: bytes, at: int, end: int) -> list[dict]:
    """Records and gaps of a sound member's content; none if there is no record in it."""
    rows = list(_salvage_plain(content))
    if not any(r["kind"] == "record" for r in rows):
        return []
    places = [(at, end - at)] + [(end, 0)] * (len(rows) - 1)
    return [
        {**r, "inner_offset": r["offset"], "inner_length": r["length"], "offset": offset, "length": length}
        for r, (offset, length) in zip(rows, places, strict=True)
    ]


def _next_version(data: bytes, start: int) -> int:
    """Where the next version line is that starts a line, or that a whole record follows (after a record that was cut off)."""
    for found in _VERSION.finditer(data, start):
        at = found.start()
        if data[at - 1 : at] == b"\n":
            return at
        try:
            _parse(data, at)
            return at
        except _Failed:
            pass
    return len(data)


def _salvage_plain(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        try:
            headers, block, end = _parse(data, at)
            row = _row(headers, block, at, end - at)
        except _Failed as failed:
            end = _next_version(data, at + 1)
            row = _gap(at, end - at, failed.reason)
        yield row
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (kind ``record``) and quarantined gaps (kind ``gap``) of all archives below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fields = spark.createDataFrame([], RECORD_SCHEMA).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=fields)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for row in salvage(content.as_py()):
                    rows.append({"path": path, **row})
                    size += len(row.get("payload") or b"")
                    if size > 4 << 20 or len(rows) >= 1_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return files.mapInArrow(run, RECORD_SCHEMA)


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that ``write_warc`` has made."""
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return records.where("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )

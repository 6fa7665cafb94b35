"""WARC archives: a writer and a sequential reader, one gzip member a record.

The reader walks an archive once: an incremental zlib decompressor inflates a
member chunk by chunk, the header names the block's length, the block is taken
by that length, and block and payload digests are verified. Records of any type and
of other writers are read; what they do not say is null, and a bad record is a row that
says what is wrong.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
MEMBER = 16 + zlib.MAX_WBITS
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that is cut off, malformed or fails its digest."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _agrees(digest: str | None, data: bytes) -> bool:
    """Whether a digest holds; one that is missing or of a kind unknown here says nothing."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() not in ("sha1", "md5", "sha256") or not value:
        return True
    made = hashlib.new(kind.lower(), data).digest()
    return value.lower() in (made.hex(), base64.b32encode(made).decode().lower(), base64.b32encode(made).decode().rstrip("=").lower())


def record_id(page_id: int | None) -> str:
    """A record id that holds the page's id in its low 64 bits; the top half is 0 for no page, else 1."""
    return f"<urn:uuid:{uuid.UUID(int=0 if page_id is None else 1 << 64 | page_id & (1 << 64) - 1)}>"


def page_of(identifier: str | None) -> int | None:
    """The page's id of an id that ``record_id`` made; null for any other."""
    try:
        number = uuid.UUID((identifier or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    low = number & (1 << 64) - 1
    return None if number >> 64 != 1 else low - (1 << 64) if low >> 63 else low


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP header but not the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, MEMBER)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


    @property
    def payload(self) -> bytes:
        """What follows the HTTP header in an HTTP message, else the whole block."""
        return self.http[1] if self.headers.get("content-type", "").startswith("application/http") else self.block


BREAKS = re.compile(rb"\r?\n\r?\n")  # ends a header, and a record


def _member(archive: memoryview, at: int) -> tuple[bytes, int]:
    """The plain bytes of the gzip member at ``at``, and where the next begins."""
    inflate, parts = zlib.decompressobj(MEMBER), []
    while not inflate.eof:
        if at >= len(archive):
            raise WarcError("the archive ends inside a member")
        piece = archive[at : at + CHUNK]
        try:
            parts.append(inflate.decompress(piece))
        except zlib.error as e:
            raise WarcError(str(e)) from e
        at += len(piece) - len(inflate.unused_data)
    return b"".join(parts), at


def _unchunked(body: bytes) -> bytes | None:
    """A body without its chunks' sizes, null if it is no chunked one."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n").match(body, at):
        n, at = int(m[1], 16), m.end()
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2
    return None


def _record(data: bytes, at: int) -> tuple[Record | None, str | None, int]:
    """(record, what is wrong with it, where the next one begins) of the record at ``at``; lines may end without a carriage return."""
    mark = BREAKS.search(data, at)
    if not mark or data[at : at + 5] != b"WARC/":
        return None, "no WARC header", len(data)
    lines = data[at : mark.start()].decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isdecimal():
        return Record(headers, b""), "the header names no length", len(data)
    end = mark.end() + int(length)
    record = Record(headers, data[mark.end() : end])
    closed = BREAKS.match(data, end) if end <= len(data) else None
    after = closed.end() if closed else end
    if not closed or not (after == len(data) or data[after : after + 5] == b"WARC/" or data[after : after + 1] == b"\0"):
        following = data.find(b"\nWARC/1.", mark.end())
        return record, "the block's length is not the header's", len(data) if following < 0 else following + 1
    if not _agrees(headers.get("warc-block-digest"), record.block):
        return record, "block digest mismatch", after
    if headers.get("warc-type") == "response" and not _agrees(headers.get("warc-payload-digest"), record.payload):
        plain = _unchunked(record.payload) if "chunked" in record.http[0].get("transfer-encoding", "").lower() else None
        if plain is None or not _agrees(headers.get("warc-payload-digest"), plain):
            return record, "payload digest mismatch", after
    return record, None, after


def scan_records(archive: bytes) -> Iterator[tuple[Record | None, str | None]]:
    """(record, None) for every sound record of one archive, in order, and (what is known, what is wrong) for every other.

    One record a gzip member is the rule; several in one, plain archives and zeros that
    fill up are taken too. Behind a bad stretch reading goes on at the next gzip head or
    WARC header.
    """
    view, at = memoryview(archive), 0
    while at < len(archive):
        if archive[at] in b"\0\r\n":
            at += 1
            continue
        if archive[at : at + 2] == b"\x1f\x8b":
            try:
                data, end = _member(view, at)
            except WarcError as e:
                yield None, str(e)
                at = archive.find(b"\x1f\x8b\x08", at + 2)
                if at < 0:
                    return
                continue
            inner = 0
            while inner < len(data):
                if data[inner] in b"\0\r\n":
                    inner += 1
                    continue
                record, wrong, inner = _record(data, inner)
                yield record, wrong
            at = end
        elif archive[at : at + 5] == b"WARC/":
            record, wrong, at = _record(archive, at)
            yield record, wrong
        else:
            yield None, "no WARC header"
            nexts = [x for x in (archive.find(b"\x1f\x8b\x08", at + 1), archive.find(b"\nWARC/1.", at)) if x >= 0]
            if not nexts:
                return
            at = min(nexts)


def read_records(archive: bytes) -> Iterator[Record]:
    """The records of one archive, in order; raises WarcError at the first bad one."""
    for record, wrong in scan_records(archive):
        if wrong:
            raise WarcError(wrong)
        yield record


def write_archives(pages: DataFrame, archive_bytes: int = 4 << 20, min_payload: int = 0) -> DataFrame:
    """Archives (``archive`` binary, ``n_records`` long) of all ``pages`` (page_id, url, html).

    Pages with equal payloads of ``min_payload`` bytes or more share the response
    of the smallest page_id, the others are revisits; rows that repeat that
    page_id are responses too. A null html is an empty payload, a null page_id
    sorts after all others and is never referred to; a null url leaves its header
    out. Other columns are ignored. Only digests that occur on several pages are
    joined back, and that side has one row a digest, so AQE can split a hot one.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    seen = own.where(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    linked = own.join(seen.where("n > 1").select("digest", "first_id"), "digest", "left")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(build_record(page, url, html.encode(), first))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([len(parts)], pa.int64())], names=["archive", "n_records"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([len(parts)], pa.int64())], names=["archive", "n_records"])

    return linked.select("page_id", "url", "html", refers).mapInArrow(pack, "archive binary, n_records long")


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """Every record of a column of whole archives (``content`` of Spark's binaryFile source works too).

    Returns page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload (null for a revisit) and error, which is null but for records that are cut
    off, malformed or fail their digest: these have a row with what is known of them. Null or empty archives hold no record. A page_id
    is null where the record has none or another writer's id; a digest that a record
    does not give is worked out from its payload, null for a revisit. An archive is
    inflated record by record; as a cell of a table it has at most 2 GB.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                out = []
                for r, wrong in scan_records(blob.as_py() or b""):
                    if r is None:
                        out.append((None, None, None, None, None, None, None, wrong))
                        continue
                    kind = r.headers.get("warc-type")
                    full = r.payload if kind != "revisit" else None
                    length = r.http[0].get("content-length", "") if full is None else str(len(full))
                    digest = r.headers.get("warc-payload-digest") or (None if full is None else _digest(full))
                    out.append((page_of(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), kind, int(length) if length.isdecimal() else None, digest and digest.removeprefix("sha1:"), page_of(r.headers.get("warc-refers-to")), full, wrong))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return archives.select(F.col(f"`{column}`")).mapInArrow(rows, schema)

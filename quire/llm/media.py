"""Media columns: payloads stored as 8-bit samples, and signature sniffing.

A payload is stored losslessly as 8-bit PCM in a RIFF/WAVE container. Sniffing
takes no declared type on trust: an Aho-Corasick automaton finds every magic
number in one pass over the bytes, a validator for each format then confirms
structure and length, and what holds at offset 0 is the type; confirmed files
that lie deeper are embedded media and can be carved out by offset and length.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

BLOCK, RATE = 64, 8000
#: Magic numbers by format.
MAGIC = {
    "RIFF": b"RIFF",
    "PNG": b"\x89PNG\r\n\x1a\n",
    "JPEG": b"\xff\xd8\xff",
    "GIF87": b"GIF87a",
    "GIF89": b"GIF89a",
    "PDF": b"%PDF-",
    "ZIP": b"PK\x03\x04",
    "OGG": b"OggS",
    "FLAC": b"fLaC",
    "MIDI": b"MThd",
    "GZIP": b"\x1f\x8b\x08",
    "ISO": b"ftyp",
    "TIFF-LE": b"II*\x00",
    "TIFF-BE": b"MM\x00*",
}


#: What ends a file of a format, or must stand in it.
MARKERS = {"EOF": b"%%EOF", "XREF": b"startxref", "ZIPEND": b"PK\x05\x06"}


@dataclass(frozen=True)
class Found:
    offset: int
    length: int
    mime: str


def _riff(b, at):
    if at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    kinds = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
    mime = kinds.get(bytes(b[at + 8 : at + 12]))
    if mime is None or at + size > len(b):
        return None
    p, end = at + 12, at + size
    while p + 8 <= end:  # the chunks fill the form exactly
        p += 8 + (n := struct.unpack_from("<I", b, p + 4)[0]) + (n & 1)
    return Found(at, size, mime) if p == end else None


def _png(b, at):
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and kind != b"IHDR":
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return Found(at, p - at, "image/png")
    return None


def _chain(known: dict, p: int, step):
    """Where the chain of parts from ``p`` on ends, null if it breaks: ``step`` gives (next place, None) or (None, end).

    ``known`` keeps the answer for every place passed, so that no part is walked twice
    however many magic numbers lead to it.
    """
    path = []
    while p not in known:
        path.append(p)
        p, end = step(p)
        if p is None:
            break
    else:
        end = known[p]
    for q in path:
        known[q] = end
    return end


def _jpeg(b, at, known):
    ends = known.setdefault("ends", [0, -1])  # from the first place to the second there is no end mark, but at the second

    def end_after(p):
        if not ends[0] <= p <= ends[1]:
            ends[:] = [p, b.find(b"\xff\xd9", p)]
            if ends[1] < 0:
                ends[1] = len(b) + 1
        return None if ends[1] > len(b) else ends[1] + 2

    def step(p):
        if p + 4 > len(b) or b[p] != 0xFF:
            return None, None
        kind, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return None, None
        return (None, end_after(p + 2 + n)) if kind == 0xDA else (p + 2 + n, None)

    end = _chain(known, at + 2, step)
    return Found(at, end - at, "image/jpeg") if end else None


def _gif(b, at, known):
    if at + 13 > len(b):
        return None
    inner = known.setdefault("inner", {})

    def blocks(p):
        return _chain(inner, p, lambda p: (p + b[p] + 1, None) if p < len(b) and b[p] else (None, p + 1))

    def step(p):
        if p >= len(b):
            return None, None
        if b[p] == 0x3B:
            return None, p + 1
        if b[p] == 0x21:
            return blocks(p + 2), None
        if b[p] == 0x2C and p + 10 <= len(b):
            return blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)), None
        return None, None

    flags = b[at + 10]
    end = _chain(known, at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), step)
    return Found(at, end - at, "image/gif") if end else None


def _pdf(b, at, marks):
    if at + 8 > len(b) or not (0x31 <= b[at + 5] <= 0x32 and b[at + 6] == 0x2E):
        return None
    ends, tables = marks["EOF"], marks["XREF"]
    k = bisect.bisect_left(tables, at)
    if not ends or k == len(tables) or not at < tables[k] < ends[-1]:
        return None
    return Found(at, ends[-1] + 5 - at, "application/pdf")


def _zip(b, at, marks):
    k = bisect.bisect_left(marks["ZIPEND"], at)
    if k == len(marks["ZIPEND"]) or marks["ZIPEND"][k] + 22 > len(b):
        return None
    end = marks["ZIPEND"][k]
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return Found(at, end + 22 + note - at, "application/zip") if start + size == end - at and end + 22 + note <= len(b) else None


def _ogg(b, at, known):
    def step(p):
        if p + 27 > len(b) or bytes(b[p : p + 5]) != b"OggS\x00":
            return None, None
        n = b[p + 26]
        q = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + 27 + n > len(b) or q > len(b):
            return None, None
        return (None, q) if b[p + 5] & 4 else (q, None)

    end = _chain(known, at, step)
    return Found(at, end - at, "audio/ogg") if end else None


def _flac(b, at):
    return Found(at, len(b) - at, "audio/flac") if at + 42 <= len(b) and b[at + 4] & 0x7F == 0 and bytes(b[at + 5 : at + 8]) == b"\0\0\x22" else None


def _midi(b, at):
    if at + 14 > len(b) or struct.unpack_from(">I", b, at + 4)[0] != 6:
        return None
    p = at + 14
    for _ in range(struct.unpack_from(">H", b, at + 10)[0]):
        if p + 8 > len(b) or bytes(b[p : p + 4]) != b"MTrk":
            return None
        p += 8 + struct.unpack_from(">I", b, p + 4)[0]
    return Found(at, p - at, "audio/midi") if p <= len(b) else None


def _gzip(b, at):
    inflate, p = zlib.decompressobj(16 + zlib.MAX_WBITS), at
    try:
        while not inflate.eof and p < len(b):
            inflate.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return None
    return Found(at, min(p, len(b)) - len(inflate.unused_data) - at, "application/gzip") if inflate.eof else None


def _iso(b, at):
    p = start = at - 4
    if start < 0 or struct.unpack_from(">I", b, start)[0] < 8:
        return None
    boxes = set()
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n < 8 or p + n > len(b) or not kind.isalnum():
            break
        boxes.add(kind)
        p += n
    return Found(start, p - start, "video/mp4") if {b"ftyp", b"moov"} <= boxes else None


def _tiff(b, at):
    order = "<" if b[at] == 0x49 else ">"
    if at + 8 > len(b):
        return None
    p = at + struct.unpack_from(order + "I", b, at + 4)[0]
    if p < at + 8 or p + 2 > len(b):
        return None
    n = struct.unpack_from(order + "H", b, p)[0]
    return Found(at, len(b) - at, "image/tiff") if n and p + 2 + 12 * n + 4 <= len(b) else None


VALIDATE = {"RIFF": _riff, "PNG": _png, "JPEG": _jpeg, "GIF87": _gif, "GIF89": _gif, "PDF": _pdf, "ZIP": _zip, "OGG": _ogg, "FLAC": _flac, "MIDI": _midi, "GZIP": _gzip, "ISO": _iso, "TIFF-LE": _tiff, "TIFF-BE": _tiff}


def automaton() -> ahocorasick.Automaton:
    """Over Latin-1 characters, which are bytes one to one."""
    found = ahocorasick.Automaton()
    for name, magic in (MAGIC | MARKERS).items():
        found.add_word(magic.decode("latin-1"), (name, len(magic)))
    found.make_automaton()
    return found


def sniff(media: bytes, finder: ahocorasick.Automaton) -> list[Found]:
    """Every confirmed file in ``media``, by offset; empty bytes have none."""
    magic, marks = [], {name: [] for name in MARKERS}
    for end, (name, n) in finder.iter(media.decode("latin-1")):
        if name in marks:
            marks[name].append(end + 1 - n)
        else:
            magic.append((name, end + 1 - n))
    known: dict[str, dict] = {"OGG": {}, "GIF": {}, "JPEG": {}}
    more = {"PDF": marks, "ZIP": marks, "OGG": known["OGG"], "GIF87": known["GIF"], "GIF89": known["GIF"], "JPEG": known["JPEG"]}
    hits = [VALIDATE[name](media, at, more[name]) if name in more else VALIDATE[name](media, at) for name, at in magic]
    return sorted({h for h in hits if h}, key=lambda h: (h.offset, -h.length))


def wrap_wave(payload: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def unwrap_wave(media: bytes) -> bytes:
    """The samples of a WAVE file's data chunk."""
    p = 12
    while p + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, p)
        if kind == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def encode_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, declared, media): each whole text, zero-padded to a positive multiple of 64 bytes, as WAVE.

    A null text is empty. Repeated rows stay repeated, other columns are left out.
    The declared type is what a careless crawler says of everything, octet-stream.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            for i in range(0, batch.num_rows, 256):
                part = [raw[p:q] for p, q in zip(at[i : i + 256], at[i + 1 : i + 257])]
                media = [wrap_wave(t + bytes(max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t))) for t in part]
                n = len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array([len(t) for t in part], pa.int64()), pa.array(["application/octet-stream"] * n), pa.array(media, pa.binary())], names=["k", "n", "d", "m"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(rows, f"`{key}` {kind}, n_bytes long, declared string, media binary")


def sniff_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, declared, mime, corrected, media_bytes, media_sha256, payload, embedded) of a table as ``encode_text`` returns it.

    ``mime`` is the confirmed type at offset 0 (the declared one where none holds),
    ``corrected`` tells whether it differs from what was declared, ``payload`` is
    the data read back from a WAVE file or else the media itself, ``embedded`` the
    confirmed files within the payload. Null media count as empty.
    """
    kind = media.schema[key].dataType.simpleString()
    found_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("mime", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for declared, blob in zip(part.column(2).to_pylist(), part.column(3)):
                    b = blob.as_py() or b""
                    found = sniff(b, finder)
                    mime = next((f.mime for f in found if f.offset == 0), declared)
                    payload = unwrap_wave(b) if mime == "audio/wav" else b
                    shift = len(b) - len(payload)
                    inner = [{"offset": f.offset - shift, "length": f.length, "mime": f.mime} for f in found if f.offset > 0]
                    out.append((mime, mime != declared, len(b), hashlib.sha256(b).hexdigest(), payload, inner))
                kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), found_type]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=[*part.schema.names[:3], "mime", "corrected", "media_bytes", "media_sha256", "payload", "embedded"])

    return media.mapInArrow(rows, f"`{key}` {kind}, n_bytes long, declared string, mime string, corrected boolean, media_bytes long, media_sha256 string, payload binary, embedded array<struct<offset:long,length:long,mime:string>>")


def carve(sniffed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, offset, length, mime, content): one row for each embedded file."""
    each = sniffed.select(key, "payload", F.explode("embedded").alias("e"))
    return each.select(key, "e.offset", "e.length", "e.mime", F.expr("substring(payload, cast(e.offset + 1 as int), cast(e.length as int))").alias("content"))

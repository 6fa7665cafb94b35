"""Document files as DataFrames: a reader to object rows and a writer from text rows.

Bytes become rows once, in Arrow batches: one row a document, one a revision, one an
object (newest version), its value as JSON. Types, edges, facts and rules are then
DataFrame operations on those rows. In the JSON a name is ``/Name``, a string
``(text``, a reference ``{"R": "12 0"}``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs
from .shared import row_batches, stored

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\((?:\\.|[^\\()])*\)|\(|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+|[{}]", re.S)
OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
DEPTH = 256


class PdfError(ValueError):
    """Bytes that do not parse."""


#: What damaged bytes may lead to; a document with any of these is read as far as it goes.
DAMAGE = (PdfError, codecs.CodecError, KeyError, TypeError, ValueError, IndexError, AttributeError, OverflowError, RecursionError, zlib.error)


def text_of(raw: bytes) -> str:
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    return raw.decode("utf-8", "replace")


def _said(raw: bytes) -> str:
    return "(" + text_of(raw)


def _kept(raw: bytes) -> str:
    """A string's bytes in hex, for documents whose strings are still encrypted."""
    return "<" + raw.hex()


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of the parenthesised string at ``at``, and where it ends."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                i = octal.end()
                continue
            nxt = data[i + 1 : i + 2]
            if nxt not in (b"\n", b"\r"):
                out += ESCAPES.get(nxt, nxt)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    raise PdfError("string without end")


def parse_value(data: bytes, at: int = 0, depth: int = 0, say=_said) -> tuple[object, int]:
    """(JSON-able value, end) of the value at ``at``; ``say`` gives what stands for a string."""
    if depth > DEPTH:
        raise PdfError("nested too deeply")
    m = TOKEN.search(data, at)
    while m and m[0].startswith(b"%"):
        m = TOKEN.search(data, m.end())
    if not m:
        raise PdfError("no value")
    t, at = m[0], m.end()
    if t == b"<<":
        out: dict = {}
        while True:
            key, at = parse_value(data, at, depth + 1, say)
            if key is _END_DICT:
                return out, at
            if not isinstance(key, str) or not key.startswith("/"):
                raise PdfError("a key is no name")
            out[key[1:]], at = parse_value(data, at, depth + 1, say)
            if out[key[1:]] in (_END_DICT, _END_ARRAY):
                raise PdfError("a key without value")
    if t == b"[":
        items: list = []
        while True:
            item, at = parse_value(data, at, depth + 1, say)
            if item is _END_ARRAY:
                return items, at
            if item is _END_DICT:
                raise PdfError("array without end")
            items.append(item)
    if t == b">>":
        return _END_DICT, at
    if t == b"]":
        return _END_ARRAY, at
    if t[:1] == b"(":
        raw, at = _literal(data, m.start())
        return say(raw), at
    if t[:1] == b"<":
        return say(codecs.hex_decode(t[1:])), at
    if t[:1] == b"/":
        return re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), t).decode("utf-8", "replace"), at
    if t in (b"true", b"false", b"null"):
        return {b"true": True, b"false": False, b"null": None}[t], at
    if re.fullmatch(rb"\d+", t):
        ref = re.compile(rb"\s+(\d+)\s+R\b").match(data, at)
        return ({"R": f"{int(t)} {int(ref[1])}"}, ref.end()) if ref else (int(t), at)
    if re.fullmatch(rb"[+-]?\d+", t):
        return int(t), at
    if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", t):
        return float(t), at
    raise PdfError(f"unknown token {t[:20]!r}")


_END_DICT, _END_ARRAY = object(), object()


def _object(data: bytes, at: int, say=_said) -> tuple[int, int, object, bytes | None]:
    """(number, generation, value, raw stream) of the object at ``at``; a broken value is null."""
    m = OBJECT.match(data, at) or OBJECT.search(data, at, at + 64)
    if not m:
        raise PdfError("no object here")
    try:
        value, end = parse_value(data, m.end(), 0, say)
    except PdfError:
        return int(m[1]), int(m[2]), None, None
    mark = re.compile(rb"\s*stream\r?\n?").match(data, end)
    if not mark or not isinstance(value, dict):
        return int(m[1]), int(m[2]), value, None
    length = value.get("Length")
    stop = mark.end() + length if isinstance(length, int) else -1
    if stop < 0 or not re.compile(rb"\s*endstream").match(data, stop):
        stop = data.find(b"endstream", mark.end())
        stop = len(data) if stop < 0 else stop
    return int(m[1]), int(m[2]), value, data[mark.end() : stop]


def filters_of(value: dict) -> list[str]:
    names = value.get("Filter") or []
    return [n[1:] for n in ([names] if isinstance(names, str) else names) if isinstance(n, str)]


def _decoded(value: dict, raw: bytes) -> bytes:
    given = value.get("DecodeParms") or {}
    each = given if isinstance(given, list) else [given]
    parms = each[0] if each else {}
    predictor = {"predictor": parms["Predictor"], "colors": parms.get("Colors", 1), "bits": parms.get("BitsPerComponent", 8), "columns": parms.get("Columns", 1)} if isinstance(parms, dict) and parms.get("Predictor", 1) > 1 else None
    return codecs.decode(raw, filters_of(value), predictor, each)


def _section(data: bytes, at: int, say=_said) -> tuple[dict, dict]:
    """({(obj, gen): (kind, offset or container, index)}, trailer) of the cross-reference section at ``at``."""
    entries: dict = {}
    if data[at : at + 4] == b"xref":
        head = re.compile(rb"xref\s+").match(data, at)
        at = head.end()
        while m := re.compile(rb"(\d+)\s+(\d+)\s+").match(data, at):
            first, at = int(m[1]), m.end()
            for k in range(int(m[2])):
                row = re.compile(rb"(\d{10})\s(\d{5})\s([nf])\s*").match(data, at)
                if not row:
                    raise PdfError("bad cross-reference row")
                if row[3] == b"n":
                    entries[first + k, int(row[2])] = ("used", int(row[1]), 0)
                else:  # from here on the number is free, whatever older sections say of the generation before
                    entries[first + k, max(0, int(row[2]) - 1)] = ("free", 0, 0)
                at = row.end()
        mark = re.compile(rb"trailer\s*").match(data, at)
        if not mark:
            raise PdfError("no trailer")
        trailer = parse_value(data, mark.end(), 0, say)[0]
        if not isinstance(trailer, dict):
            raise PdfError("the trailer is no dictionary")
        if isinstance(trailer.get("XRefStm"), int):  # a hybrid file: its stream tells of objects that the table calls free
            for key, entry in _section(data, trailer["XRefStm"], say)[0].items():
                if entries.get(key, ("free",))[0] == "free":
                    entries[key] = entry
        return entries, trailer
    _, _, value, raw = _object(data, at, say)
    if not isinstance(value, dict) or value.get("Type") != "/XRef" or raw is None:
        raise PdfError("no cross-reference section")
    body, widths = _decoded(value, raw), value.get("W")
    if not (isinstance(widths, list) and len(widths) >= 3 and all(isinstance(w, int) and w >= 0 for w in widths) and sum(widths)):
        raise PdfError("bad field widths")
    index, step, pos = value.get("Index") or [0, value["Size"]], sum(widths[:3]), 0
    for first, count in zip(index[::2], index[1::2]):
        for k in range(count):
            row, cut = body[pos : pos + step], [0, widths[0], widths[0] + widths[1], step]
            a, b, c = (int.from_bytes(row[i:j], "big") for i, j in zip(cut, cut[1:]))
            kind = a if widths[0] else 1
            pos += step
            if pos > len(body):
                raise PdfError("the cross-reference stream ends early")
            if kind == 0:
                entries[first + k, max(0, c - 1)] = ("free", 0, 0)
            if kind == 1:
                entries[first + k, c] = ("used", b, 0)
            elif kind == 2:
                entries[first + k, 0] = ("packed", b, c)
    return entries, value


def read_document(data: bytes, raw: bool = False) -> list[tuple]:
    """Rows (kind, rev, obj, gen, offset, value JSON, stream) of one document; damaged ones are scanned for objects.

    With ``raw`` strings are ``<`` and their bytes in hex, streams are as they are in the
    file, and objects inside object streams are null: what decryption starts from.
    """
    say = _kept if raw else _said
    head = re.search(rb"%PDF-(\d)\.(\d)", data[:1024])
    starts = list(re.finditer(rb"startxref\s+(\d+)", data))
    sections, at, seen, recovered = [], int(starts[-1][1]) if starts else -1, set(), False
    try:
        while at >= 0 and at not in seen:
            if at >= len(data):
                raise PdfError("a section beyond the end")
            seen.add(at)
            sections.append(_section(data, at, say))
            at = sections[-1][1].get("Prev", -1)
            if not isinstance(at, int):
                raise PdfError("the older section's place is no number")
        if not sections:
            raise PdfError("no section")
    except DAMAGE:
        recovered = True
        found = {(int(m[1]), int(m[2])): ("used", m.start(), 0) for m in OBJECT.finditer(data)}
        last = data.rfind(b"trailer")
        try:
            trailer = parse_value(data, last + 7, 0, say)[0] if last >= 0 else {}
        except DAMAGE:
            trailer = {}
        sections = [(found, trailer if isinstance(trailer, dict) else {})]
    newest: dict = {}
    for rev, (entries, _) in enumerate(sections):
        for key, entry in entries.items():
            newest.setdefault(key, (rev, entry))
    trailer = {k: v for k, v in sections[0][1].items() if k in ("Root", "Info", "Size", "ID", "Encrypt", "Prev")}
    eof = data.rfind(b"%%EOF")
    rest = data[eof + 5 :] if eof >= 0 else b""
    newest = {key: found for key, found in newest.items() if found[1][0] != "free"}
    whole = {"header": data[:5] == b"%PDF-", "has_xref": b"xref" in data, "has_trailer": b"trailer" in data, "ends": data.endswith(b"%%EOF"), "declared": data.count(b" obj"), "entries": len({key[0] for entries, _ in sections for key in entries}), "startxrefs": len(starts), "unclosed": sum(b"endobj" not in part for part in data.split(b" obj")[1:])}
    facts = {"version": f"{head[1].decode()}.{head[2].decode()}" if head else "1.7", "size": len(data), "revisions": len(sections), "recovered": recovered, "eof_marks": data.count(b"%%EOF"), "trailing": bool(rest.strip()), "trailer": trailer, **whole}
    rows = [("doc", 0, None, None, None, json.dumps(facts), None)]
    rows += [("rev", rev, key[0], key[1], None, None, None) for rev, (entries, _) in enumerate(sections) for key, entry in entries.items() if entry[0] != "free"]
    packed: dict[int, list] = {}
    for (obj, gen), (rev, (kind, where, index)) in sorted(newest.items()):
        try:
            if kind == "used":
                number, _, value, body = _object(data, where, say)
                if number != obj:
                    raise PdfError("another object is here")
            elif raw:
                value, body = None, None
            else:
                if where not in packed:
                    _, _, outer, inner = _object(data, newest[where, 0][1][1])
                    plain = _decoded(outer, inner)
                    pairs = list(map(int, plain[: outer["First"]].split()))
                    packed[where] = [parse_value(plain, outer["First"] + o)[0] for o in pairs[1::2]]
                value, body = packed[where][index], None
        except DAMAGE:
            value, body = None, None
        stream = body
        if body is not None and not raw:
            try:
                stream = _decoded(value, body)
            except DAMAGE:
                pass
        rows.append(("object", rev, obj, gen, where if kind == "used" else None, json.dumps(value, ensure_ascii=False), stream))
    return rows


ROWS = "doc_id long, kind string, rev int, obj int, gen int, offset long, value string, stream binary"


def parse(files: DataFrame, raw: bool = False) -> DataFrame:
    """Object rows of a table (doc_id, content binary); null content has none. ``raw``: see ``read_document``."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = ((doc.as_py(), content.as_py()) for doc, content in zip(batch.column(0), batch.column(1)))
            read = ((doc, read_document(data, raw), len(data)) for doc, data in contents if data is not None)
            yield from row_batches(read, [x.split()[0] for x in ROWS.split(", ")], [pa.int64(), *kinds])

    return files.select("doc_id", "content").mapInArrow(rows, ROWS)


def read(spark: SparkSession, path: str, recursive: bool = False, max_bytes: int = 100 << 20) -> DataFrame:
    """(doc_id, path, content) of the document files under ``path`` up to a size, by suffix or magic number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).where(F.col("length") <= max_bytes)
    bare = ~F.element_at(F.split("path", "/"), -1).contains(".")
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    return files.where(F.lower("path").endswith(".pdf") | (bare & magic)).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def document_facts(value: Column) -> list[Column]:
    """The columns of a document's facts, from the value of its ``doc`` row."""
    fact = lambda name: F.get_json_object(value, f"$.{name}")
    ids = F.filter(F.from_json(fact("trailer.ID"), "array<string>"), lambda x: x.startswith("("))
    kinds = {"size": "long", "revisions": "int", "recovered": "boolean", "eof_marks": "int", "header": "boolean", "has_xref": "boolean", "has_trailer": "boolean", "ends": "boolean", "declared": "long", "entries": "long", "startxrefs": "int", "unclosed": "long"}
    return [fact("version").alias("version"), *(fact(k).cast(t).alias(k) for k, t in kinds.items()), fact("trailing").cast("boolean").alias("has_trailing"), fact("trailer.Encrypt").isNotNull().alias("encrypted"), fact("trailer.Root.R").alias("root"), fact("trailer.Size").cast("long").alias("trailer_size"), fact("trailer.ID").isNotNull().alias("has_id"), F.coalesce(F.size(ids) == 2, F.lit(False)).alias("two_ids")]


def documents(rows: DataFrame) -> DataFrame:
    """(doc_id and ``document_facts``) of every document."""
    return rows.where("kind = 'doc'").select("doc_id", *document_facts(F.col("value")))


def type_of(value: Column, stream: Column) -> Column:
    """An object's type by its dictionary."""
    entry = lambda name: F.get_json_object(value, f"$.{name}")
    kind, sub, act = entry("Type"), entry("Subtype"), entry("S")
    return (
        F.when(kind.isin("/Catalog", "/Pages", "/Page", "/Font", "/Sig", "/Filespec", "/EmbeddedFile", "/ObjStm", "/XRef", "/Metadata"), F.substring(kind, 2, 30))
        .when((kind == "/Annot") | sub.isin("/Link", "/Widget"), "Annotation")
        .when(act == "/JavaScript", "JavaScriptAction")
        .when(act == "/URI", "URIAction")
        .when(act == "/Launch", "LaunchAction")
        .when(kind == "/Action", "Action")
        .when(sub == "/Image", "Image")
        .when(stream.isNotNull(), "ContentStream")
        .otherwise("Object")
    )


def objects(rows: DataFrame) -> DataFrame:
    """(doc_id, node_id, node_type, value, stream): one node an object, typed by its dictionary."""
    node_type = type_of(F.col("value"), F.col("stream")).alias("node_type")
    return rows.where("kind = 'object'").select("doc_id", F.concat_ws(" ", "obj", "gen").alias("node_id"), node_type, "value", "stream")


def object_references(nodes: DataFrame) -> DataFrame:
    """(doc_id, src, dst) of every reference in every value, targets not checked."""
    refs = F.regexp_extract_all("value", F.lit(r'"R": "(\d+ \d+)"'), 1)
    return nodes.select("doc_id", F.col("node_id").alias("src"), F.explode(refs).alias("dst"))


#: Edges by the dictionary entry that holds the reference.
TYPED = {"Kids": "Child", "Pages": "Child", "Contents": "Content", "Annots": "Annotation", "A": "Action", "OpenAction": "Action", "Next": "Action", "Fields": "Field", "AcroForm": "Form", "Metadata": "Metadata", "Resources": "Resource", "Font": "Resource", "XObject": "Resource", "Outlines": "Outline", "First": "Outline", "Names": "Name", "Parent": "Parent"}


def typed_edges(nodes: DataFrame) -> DataFrame:
    """(doc_id, src, dst, edge_type, ord): references in the entries of a node's own dictionary, by entry, and in order within it."""
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    each = nodes.where(F.col("value").startswith("{")).select("doc_id", F.col("node_id").alias("src"), F.explode(entries).alias("e"))
    kinds = F.create_map(*(F.lit(x) for kv in TYPED.items() for x in kv))
    named = each.select("doc_id", "src", F.coalesce(kinds[F.col("e.key")], F.lit("Reference")).alias("edge_type"), F.posexplode(F.regexp_extract_all("e.value", F.lit(r'"R":\s*"(\d+ \d+)"'), 1)).alias("ord", "dst"))
    return named.select("doc_id", "src", "dst", "edge_type", F.col("ord").cast("long").alias("ord"))


def ordered_pages(nodes: list[tuple[str, str, list[str]]]) -> list[str]:
    """Page ids of one document's (node_id, node_type, kids) in the order of its page tree.

    The tree is gone through level by level from the catalogs; of several ways to a node
    the shortest counts, of equally long ones the first. Pages it does not reach follow
    by object number.
    """
    kids = {node: below for node, _, below in nodes}
    level = {node: () for node, kind, _ in nodes if kind == "Catalog"}
    paths: dict[str, tuple] = {}
    while level:
        paths |= level
        below: dict[str, tuple] = {}
        for node, path in level.items():
            for k, kid in enumerate(kids.get(node, ())):
                if kid not in paths and (kid not in below or (*path, k) < below[kid]):
                    below[kid] = (*path, k)
        level = below
    pages = [node for node, kind, _ in nodes if kind == "Page"]
    return sorted(pages, key=lambda node: (node not in paths, paths.get(node, ()), int(node.split(" ")[0])))


def page_order(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, page): pages numbered from 1 in the order of the page tree; those it does not reach follow by object number.

    A document's catalog and page tree, without streams, meet in one row; see ``ordered_pages``.
    """
    ref = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'"R":\s*"(\d+ \d+)"'), 1)
    entry = lambda name: F.get_json_object("value", f"$.{name}")
    kids = F.when(F.col("node_type") == "Page", F.array().cast("array<string>")).otherwise(F.concat(ref(entry("Pages")), ref(entry("Kids"))))
    tree = nodes.where("node_type in ('Catalog', 'Pages', 'Page')").select("doc_id", F.struct("node_id", "node_type", kids.alias("kids")).alias("n"))
    by = tree.groupBy("doc_id").agg(F.collect_list("n").alias("nodes"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, listed in zip(batch.column(0), batch.column(1)):
                pages = ordered_pages([(n["node_id"], n["node_type"], n["kids"]) for n in listed.as_py()])
                if pages:
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(pages), pa.int64()), pa.array(pages), pa.array(range(1, len(pages) + 1), pa.int32())], names=["doc_id", "node_id", "page"])

    return by.mapInArrow(rows, "doc_id long, node_id string, page int")


def shown_text(ops: bytes) -> str:
    """What a content stream's text operators show: a line for each line of text, a gap or a wide step as a space."""
    out, stack, fresh, at, last = [], [], False, 0, None

    def show(value: object) -> None:
        nonlocal fresh
        if isinstance(value, str) and value.startswith("("):
            if fresh and out:
                out.append("\n")
            fresh = False
            out.append(value[1:])

    while m := TOKEN.search(ops, at):
        t = m[0]
        if t[:1] == b"%":
            at = m.end()
            continue
        try:
            value, at = parse_value(ops, m.start())
            stack.append(value)
            continue
        except PdfError:
            at = m.end()
        number = [v for v in stack if isinstance(v, (int, float)) and not isinstance(v, bool)]
        if t in (b"Tj", b"'", b'"') and stack:
            fresh = fresh or t != b"Tj"
            show(stack[-1])
        elif t == b"TJ" and stack and isinstance(stack[-1], list):
            for item in stack[-1]:
                if isinstance(item, (int, float)) and item <= -200 and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
                show(item)
        elif t == b"T*":
            fresh = True
        elif t in (b"Td", b"TD") and len(number) >= 2:
            if number[-1]:
                fresh = True
            elif number[-2] and out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
        elif t == b"Tm" and len(number) >= 6:
            fresh, last = fresh or last != number[-1], number[-1]
        elif t == b"BT":
            fresh = True
        elif t == b"BI":  # an inline image: its bytes are no operators
            end = re.compile(rb"\bID\s.*?\sEI\b", re.S).search(ops, at)
            at = end.end() if end else at
        stack.clear()
    return "".join(out)


def page_texts(nodes: DataFrame, keep: bool = True) -> DataFrame:
    """(doc_id, page, text) of what each page's content streams, one or several, show, in their order; pages by the page tree.

    ``keep`` stores what is needed of ``nodes``; without it they are read from where they are.
    """
    kept = nodes.where("node_type in ('Catalog', 'Pages', 'Page') or stream is not null")
    kept = stored(kept, "objects") if keep else kept
    pages = kept.where("node_type = 'Page'")
    contents = F.regexp_extract_all(F.get_json_object("value", "$.Contents"), F.lit(r'"R":\s*"(\d+ \d+)"'), 1)
    parts = pages.select("doc_id", "node_id", F.posexplode(contents).alias("place", "contents"))
    streams = kept.where("stream is not null").select("doc_id", F.col("node_id").alias("contents"), "stream")

    @F.pandas_udf("string")
    def shown(streams: pd.Series) -> pd.Series:
        return streams.map(lambda ops: None if ops is None else shown_text(bytes(ops)))

    joined = parts.join(streams, ["doc_id", "contents"]).select("doc_id", "node_id", "place", shown("stream").alias("text")).where("text <> ''")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
    texts = joined.groupBy("doc_id", "node_id").agg(lines.alias("text"))
    return page_order(kept).join(texts, ["doc_id", "node_id"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))


#: Signatures of formats that a file may be as well.
SIGNATURES = {
    "ZIP": b"PK\x03\x04",
    "ZIP_EOCD": b"PK\x05\x06",
    "RAR": b"Rar!\x1a\x07\x00",
    "7Z": b"7z\xbc\xaf\x27\x1c",
    "ELF": b"\x7fELF",
    "MZ": b"MZ",
    "OLE": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",
    "PNG": b"\x89PNG\r\n\x1a\n",
    "JPEG": b"\xff\xd8\xff",
    "GIF87a": b"GIF87a",
    "GIF89a": b"GIF89a",
    "MP4": b"ftyp",
}
HEAD_AND_TAIL = 256 << 10


def signature_hits(files: DataFrame, window: int = HEAD_AND_TAIL) -> DataFrame:
    """(doc_id, format, offset) of every signature in the first or last ``window`` bytes of (doc_id, content), each place once."""
    text = F.decode("content", "ISO-8859-1")
    magic = F.explode(F.array(*(F.struct(F.lit(k).alias("format"), F.lit(m.decode("latin-1")).alias("magic")) for k, m in SIGNATURES.items()))).alias("m")
    held = files.select("doc_id", text.alias("text")).select("doc_id", "text", magic).where(F.contains("text", "m.magic"))
    # every split is just before a signature, so what is ahead of it adds up to its place
    parts = held.select("doc_id", "m.format", "m.magic", F.length("text").alias("size"), F.startswith("text", "m.magic").alias("first"), F.posexplode(F.split("text", F.concat(F.lit(r"(?=\Q"), "m.magic", F.lit(r"\E)")))).alias("k", "part"))
    ahead = F.sum(F.length("part")).over(Window.partitionBy("doc_id", "format").orderBy("k")) - F.length("part")
    hits = parts.withColumn("offset", ahead).where((F.col("k") > 0) | F.col("first"))
    whole = (F.col("offset") + F.length("magic") <= window) | (F.col("offset") >= F.col("size") - window)
    return hits.where(whole).select("doc_id", "format", F.col("offset").cast("long").alias("offset"))


def heuristics(rows: DataFrame) -> DataFrame:
    """(doc_id, check, n) of what does not fit together in a parsed document's bytes and tables."""
    doc = documents(rows)
    beyond = rows.where("kind = 'object' and offset is not null").join(doc.select("doc_id", "size"), "doc_id").where("offset >= size").groupBy("doc_id").agg(F.count(F.lit(1)).alias("beyond"))
    checks = {
        "TrailingData": F.col("has_trailing").cast("long"),
        "MultipleEOF": F.when(F.col("eof_marks") > 1, F.col("eof_marks")).cast("long"),
        "MultipleStartXref": F.when((F.col("revisions") <= 1) & (F.col("startxrefs") > 1), F.col("startxrefs")).cast("long"),
        "XRefOffsetOutOfBounds": F.col("beyond"),
        "TrailerSizeMismatch": F.when(F.col("entries") < F.col("trailer_size"), F.col("trailer_size") - F.col("entries")),
        "MissingEndObj": F.col("unclosed"),
    }
    found = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for k, n in checks.items()))
    return doc.join(beyond, "doc_id", "left").select("doc_id", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("f")).select("doc_id", "f.*")


def render(doc_id: int, text: str, lines_per_page: int = 40) -> bytes:
    """A document with ``text``, and features by its number: see ``FEATURES``."""
    lines = text.split("\n")
    pages = [lines[k : k + lines_per_page] for k in range(0, len(lines), lines_per_page)]
    body: dict[int, bytes] = {}
    flate = doc_id % 3 == 0
    kids, number = [], 10
    for page in pages:
        ops = b"BT /F1 12 Tf 72 760 Td\n" + b"".join(b"<FEFF" + line.encode("utf-16-be").hex().upper().encode() + b"> Tj 0 -14 Td\n" for line in page) + b"ET"
        data, extra = (zlib.compress(ops), b" /Filter /FlateDecode") if flate else (ops, b"")
        body[number] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R%s >>" % (number + 1, b" /Annots [5 0 R]" if doc_id % 7 == 0 and number == 10 else b"")
        body[number + 1] = b"<< /Length %d%s >>\nstream\n" % (len(data), extra) + data + b"\nendstream"
        kids.append(number)
        number += 2
    body[1] = b"<< /Type /Catalog /Pages 2 0 R%s%s >>" % (b" /OpenAction 4 0 R" if doc_id % 5 == 0 else b"", b" /Names << /EmbeddedFiles << /Names [(a) 7 0 R] >> >>" if doc_id % 8 == 3 else b"")
    body[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    body[3] = b"<< /Producer (Quire) /Title (Document \\(%d\\)) >>" % doc_id
    if doc_id % 5 == 0:
        body[4] = b"<< /S /JavaScript /JS (app.alert\\(1\\)) >>"
    if doc_id % 7 == 0:
        body[5] = b"<< /Type /Annot /Subtype /Link /A 6 0 R >>"
        body[6] = b"<< /S /URI /URI (http://example.com/%d) >>" % doc_id
    if doc_id % 8 == 3:
        body[7] = b"<< /Type /Filespec /F (file.exe) >>"
    out = bytearray(b"%PDF-1." + str(4 + doc_id % 4).encode() + b"\n")
    places = {}
    for k in sorted(body):
        places[k] = len(out)
        out += b"%d 0 obj\n" % k + body[k] + b"\nendobj\n"

    def section(entries: dict[int, int], extra: bytes) -> int:
        start = len(out)
        out.extend(b"xref\n")
        for k in sorted(entries):
            out.extend(b"%d 1\n%010d 00000 n \n" % (k, entries[k]))
        out.extend(b"trailer\n<< /Size %d /Root 1 0 R /Info 3 0 R%s%s >>\nstartxref\n%d\n%%%%EOF\n" % (number, extra, b" /Encrypt 9 0 R" if doc_id % 10 == 7 else b"", start))
        return start

    first = section(places, b"")
    if doc_id % 4 == 1:
        again = {3: len(out), 8: 0}
        out += b"3 0 obj\n<< /Producer (Quire) /Title (Revised) >>\nendobj\n"
        again[8] = len(out)
        out += b"8 0 obj\n[1 2.5 /Three (four) null true 1 0 R]\nendobj\n"
        section(again, b" /Prev %d" % first)
    if doc_id % 6 == 2:
        out += b"MZ"
    if doc_id % 9 == 8:  # a wrong startxref, so that the reader has to scan
        at = out.rfind(b"startxref")
        out[at:] = re.sub(rb"startxref\n\d+", b"startxref\n999999999", bytes(out[at:]))
    return bytes(out)


FEATURES = {3: "Flate streams (rest 0)", 5: "JavaScript (0)", 7: "URI annotation (0)", 4: "second revision (1)", 6: "trailing bytes (2)", 8: "embedded file (3)", 10: "encryption key (7)", 9: "broken startxref (8)"}


def rendered(texts: DataFrame) -> DataFrame:
    """(doc_id, content) of (doc_id, text) rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                files = [render(k, t or "") for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], names=["doc_id", "content"])

    return texts.select("doc_id", "text").mapInArrow(rows, "doc_id long, content binary")

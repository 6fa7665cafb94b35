"""Signed data as rows: the DER tree of a blob, its signers, certificates, chains, stamps and checks.

A blob's bytes become one row a tag-length-value node; all that follows are joins of
those rows by (blob, parent). Only two things are worked out beside Spark's own
functions, a value at a time: the walk over the bytes and the RSA power.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, row_batches, stored

DEPTH = 64
#: Object identifiers of digests, signature algorithms, attributes, name parts, key purposes.
DIGESTS = {"1.2.840.113549.2.5": "MD5", "1.3.14.3.2.26": "SHA-1", "2.16.840.1.101.3.4.2.1": "SHA-256", "2.16.840.1.101.3.4.2.2": "SHA-384", "2.16.840.1.101.3.4.2.3": "SHA-512"}
SIGNED_WITH = {"1.2.840.113549.1.1.4": "MD5", "1.2.840.113549.1.1.5": "SHA-1", "1.2.840.113549.1.1.11": "SHA-256", "1.2.840.113549.1.1.12": "SHA-384", "1.2.840.113549.1.1.13": "SHA-512"}
RSA = "1.2.840.113549.1.1.1"
SIGNED_DATA, STAMP_INFO = "1.2.840.113549.1.7.2", "1.2.840.113549.1.9.16.1.4"
CONTENT_TYPE, MESSAGE_DIGEST, SIGNING_TIME, STAMP_TOKEN = "1.2.840.113549.1.9.3", "1.2.840.113549.1.9.4", "1.2.840.113549.1.9.5", "1.2.840.113549.1.9.16.2.14"
NAME_PARTS = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "1.2.840.113549.1.9.1": "E", "0.9.2342.19200300.100.1.25": "DC"}
KEY_USAGE, CONSTRAINTS, POINTS, ACCESS, PURPOSES = "2.5.29.15", "2.5.29.19", "2.5.29.31", "1.3.6.1.5.5.7.1.1", "2.5.29.37"
OCSP, ISSUERS = "1.3.6.1.5.5.7.48.1", "1.3.6.1.5.5.7.48.2"
USES = ("Digital Signature", "Non Repudiation", "Key Encipherment", "Data Encipherment", "Key Agreement", "Key Cert Sign", "CRL Sign", "Encipher Only", "Decipher Only")
CHARSETS = {12: "utf-8", 18: "ascii", 19: "ascii", 20: "latin-1", 22: "ascii", 26: "ascii", 28: "utf-32-be", 30: "utf-16-be"}


class DerError(ValueError):
    """Bytes that are no tag-length-value tree."""


def _oid(raw: bytes) -> str:
    parts, n = [], 0
    for b in raw:
        n = n << 7 | b & 127
        if b < 128:
            parts.append(n)
            n = 0
    if not parts:
        return ""
    top = min(parts[0] // 40, 2)
    return ".".join(map(str, (top, parts[0] - 40 * top, *parts[1:])))


def _time(raw: bytes, wide: bool) -> str | None:
    """``yyyy-MM-dd HH:mm:ss`` in UTC of a UTCTime or GeneralizedTime."""
    m = re.fullmatch(rb"(\d{%d})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)?(?:[.,]\d+)?(Z|[+-]\d{4})?" % (4 if wide else 2), raw)
    if not m:
        return None
    year = int(m[1]) if wide else int(m[1]) + (2000 if int(m[1]) < 50 else 1900)
    try:
        at = pd.Timestamp(year, *(int(x or 0) for x in m.groups()[1:6]))
    except ValueError:
        return None
    if m[7] and m[7] != b"Z":
        sign = 1 if m[7][:1] == b"+" else -1
        at -= sign * pd.Timedelta(hours=int(m[7][1:3]), minutes=int(m[7][3:5]))
    return str(at)


def _text(tag: int, raw: bytes) -> str | None:
    """What a primitive universal value says, where it says something short."""
    if tag == 1:
        return str(any(raw)).lower()
    if tag in (2, 10):
        return str(int.from_bytes(raw, "big", signed=True)) if raw and len(raw) <= 64 else raw.hex()
    if tag == 6:
        return _oid(raw)
    if tag in CHARSETS:
        return raw.decode(CHARSETS[tag], "replace")
    if tag in (23, 24):
        return _time(raw, tag == 24)
    return None


def der_walk(data: bytes) -> list[tuple]:
    """(path, parent, place, depth, class, constructed, tag, start, header, length, value, text) of the first value in ``data``.

    Paths count children from 0; parents come before their children. Indefinite lengths
    are followed to their end mark, what lies behind the value is left alone. Bytes that
    do not fit end the walk: its last row then has tag -1 and says what is wrong, and the
    nodes that were still open are left out.
    """
    out: list = []

    def one(at: int, stop: int, path: str, parent: str | None, place: int, depth: int) -> int:
        if depth > DEPTH:
            raise DerError("nested too deeply")
        if at + 2 > stop:
            raise DerError("a value without length")
        kind, constructed, tag, i = data[at] >> 6, bool(data[at] & 32), data[at] & 31, at + 1
        if tag == 31:
            tag, more = 0, True
            while more:
                if i >= stop or tag > 1 << 24:
                    raise DerError("a long tag without end")
                tag, more, i = tag << 7 | data[i] & 127, data[i] > 127, i + 1
        if i >= stop:
            raise DerError("a value without length")
        size, i = data[i], i + 1
        endless = size == 128
        if endless and not constructed:
            raise DerError("a primitive value without length")
        if size > 128:
            count = size & 127
            if count > 4 or i + count > stop:
                raise DerError("a length of too many bytes")
            size, i = int.from_bytes(data[i : i + count], "big"), i + count
        body, me = i, len(out)
        if not endless and body + size > stop:
            raise DerError("a value beyond its parent")
        out.append(None)
        if constructed:
            k = 0
            while data[i : i + 2] != b"\0\0" if endless else i < body + size:
                i = one(i, stop if endless else body + size, f"{path}.{k}", path, k, depth + 1)
                k += 1
            size = i - body
        value = None if constructed else data[body : body + size]
        out[me] = (path, parent, place, depth, kind, constructed, tag, at, body - at, size, value, _text(tag, value) if value is not None and kind == 0 else None)
        return body + size + 2 * endless

    try:
        one(0, len(data), "0", None, 0, 0)
    except DerError as e:
        out = [row for row in out if row]
        out.append(("!", None, len(out), 0, 0, False, -1, 0, 0, 0, None, str(e)))
    return out


NODES = "path string, parent string, place int, depth int, class int, constructed boolean, tag int, start int, header int, length int, value binary, text string"


def der_nodes(blobs: DataFrame, key: str = "blob", content: str = "content") -> DataFrame:
    """(key, ``NODES``) of every blob: see ``der_walk``; a null blob has none, an empty one an error row."""
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walked = ((name, der_walk(data), len(data)) for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if data is not None)
            yield from row_batches(walked, [key, *(x.split()[0] for x in NODES.split(", "))], [batch.column(0).type, *types])

    kind = blobs.schema[key].dataType.simpleString()
    return blobs.select(F.col(key), F.col(content)).mapInArrow(rows, f"`{key}` {kind}, {NODES}")


def raw_of(content: Column, start: Column, header: Column, length: Column) -> Column:
    """A node's own bytes, tag and length included."""
    return F.substr(content, start + 1, header + length)


def _under(nodes: DataFrame, parents: DataFrame, of: str, *take: str, depth: int | None = None) -> DataFrame:
    """Children of ``parents`` (blob, path column ``of``, ...) with the columns ``take`` of the child; ``depth`` is theirs where it is known."""
    kids = (nodes if depth is None else nodes.where(F.col("depth") == depth)).select("blob", F.col("parent").alias(of), *take)
    return parents.join(kids, ["blob", of])


def _named(codes: dict[str, str], oid: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.coalesce(table[oid], oid)


def _first(condition: Column, value: str | Column) -> Column:
    return F.min(F.when(condition, F.col(value) if isinstance(value, str) else value))


def signed_data(nodes: DataFrame) -> DataFrame:
    """(blob, root, version, content_type, content, certificates, signers): the parts of every SignedData, as paths of ``nodes``.

    ``content`` is the enclosed content's bytes, null if it is detached.
    """
    top = nodes.where((F.col("tag") == 6) & (F.col("path") == "0.0") & (F.col("text") == SIGNED_DATA)).select("blob", F.lit("0.1").alias("holder"))
    root = _under(nodes, top, "holder", F.col("path").alias("root"), "tag", depth=2).where("tag = 16").select("blob", "root")
    parts = _under(nodes, root, "root", "path", "place", F.col("class").alias("kind"), "tag", "text", depth=3)
    one = parts.groupBy("blob", "root").agg(
        _first((F.col("place") == 0) & (F.col("tag") == 2), "text").cast("int").alias("version"),
        _first((F.col("place") == 2), "path").alias("enclosed"),
        _first((F.col("kind") == 2) & (F.col("tag") == 0), "path").alias("certificates"),
        F.max(F.when((F.col("kind") == 0) & (F.col("tag") == 17) & (F.col("place") > 2), F.col("path"))).alias("signers"),
    )
    kind = nodes.where("depth = 4 and place = 0 and tag = 6").select("blob", F.col("parent").alias("enclosed"), F.col("text").alias("content_type"))
    body = nodes.where("depth = 5 and class = 0 and tag = 4").select("blob", F.regexp_replace("parent", r"\.1$", "").alias("enclosed"), F.col("parent").alias("holder"), F.col("value").alias("content")).where("holder <> enclosed").drop("holder")
    return one.join(kind, ["blob", "enclosed"], "left").join(body, ["blob", "enclosed"], "left").select("blob", "root", "version", "content_type", "content", "certificates", "signers")


def attributes(nodes: DataFrame, parents: DataFrame, of: str, depth: int | None = None) -> DataFrame:
    """(blob, ``of``, oid, path, tag, value, text): the first value of each attribute under the nodes ``parents`` (blob, ``of``), all at ``depth`` if it is given."""
    below = lambda k: None if depth is None else depth + k
    each = _under(nodes, parents.select("blob", of), of, F.col("path").alias("attribute"), depth=below(1))
    kinds = nodes.where("tag = 6 and place = 0").select("blob", F.col("text").alias("oid"), "parent", "depth")
    kinds = kinds if depth is None else kinds.where(F.col("depth") == below(2))
    named = each.join(kinds.select("blob", F.col("parent").alias("attribute"), "oid"), ["blob", "attribute"])
    sets = _under(nodes, named, "attribute", F.col("path").alias("set"), F.col("tag").alias("is"), depth=below(2)).where("is = 17")
    return _under(nodes, sets, "set", "path", "place", "tag", "value", "text", depth=below(3)).where("place = 0").select("blob", of, "oid", "path", "tag", "value", "text")


def signers(nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """(blob, signer, issuer, serial, digest, algorithm, message_digest, signing_time, signed_attributes, signature, stamp) of every signer of SignedData ``blobs`` (blob, content).

    ``issuer`` is the raw name in hex and ``serial`` the integer's hex, as certificates
    have them; ``signed_attributes`` are the bytes that the signature covers (with the
    tag of a set), null without any; ``stamp`` is the raw time-stamp token.
    """
    whole = signed_data(nodes).where("signers is not null").select("blob", F.col("signers").alias("all"))
    each = _under(nodes, whole, "all", F.col("path").alias("signer"), F.col("tag").alias("is"), depth=4).where("is = 16").select("blob", "signer")
    parts = _under(nodes, each, "signer", "path", "place", F.col("class").alias("kind"), "tag", "value", depth=5)
    own = parts.groupBy("blob", "signer").agg(
        _first((F.col("place") == 1) & (F.col("tag") == 16), "path").alias("sid"),
        _first(F.col("place") == 2, "path").alias("digested"),
        _first((F.col("kind") == 2) & (F.col("tag") == 0) & (F.col("place") > 2), "path").alias("attrs"),
        _first((F.col("kind") == 0) & (F.col("tag") == 16) & (F.col("place") > 2), "path").alias("signed_with"),
        F.max(F.when((F.col("kind") == 0) & (F.col("tag") == 4), F.col("value"))).alias("signature"),
        _first((F.col("kind") == 2) & (F.col("tag") == 1) & (F.col("place") > 2), "path").alias("unsigned"),
    )
    own = stored(own, "signers")  # three joins below start from it
    oid = nodes.where("depth = 6 and place = 0 and tag = 6").select("blob", "parent", "text")
    for column, name in (("digested", "digest_oid"), ("signed_with", "algorithm_oid")):
        own = own.join(oid.select("blob", F.col("parent").alias(column), F.col("text").alias(name)), ["blob", column], "left")
    place = lambda k, tag: nodes.where(f"depth = 6 and place = {k} and tag = {tag}").select("blob", F.col("parent").alias("sid"), "start", "header", "length", "value")
    named = own.join(place(0, 16).select("blob", "sid", F.struct("start", "header", "length").alias("issuer_at")), ["blob", "sid"], "left").join(place(1, 2).select("blob", "sid", F.hex("value").alias("serial")), ["blob", "sid"], "left")
    given = attributes(nodes, own.where("attrs is not null"), "attrs", 5).groupBy("blob", "attrs").agg(F.max(F.when(F.col("oid") == MESSAGE_DIGEST, F.col("value"))).alias("message_digest"), F.max(F.when(F.col("oid") == SIGNING_TIME, F.col("text"))).alias("signing_time"))
    at = nodes.where("depth = 5").select("blob", F.col("path").alias("attrs"), F.struct("start", "header", "length").alias("attrs_at"))
    stamps = attributes(nodes, own.where("unsigned is not null"), "unsigned", 5).where(F.col("oid") == STAMP_TOKEN).join(nodes.where("depth = 8").select("blob", "path", F.struct("start", "header", "length").alias("stamp_at")), ["blob", "path"]).groupBy("blob", "unsigned").agg(F.min("stamp_at").alias("stamp_at"))
    joined = named.join(given, ["blob", "attrs"], "left").join(at, ["blob", "attrs"], "left").join(stamps, ["blob", "unsigned"], "left").join(blobs.select("blob", "content"), "blob")
    raw = lambda c: raw_of(F.col("content"), F.col(f"{c}.start"), F.col(f"{c}.header"), F.col(f"{c}.length"))
    covered = F.concat(F.lit(b"\x31"), F.expr("substring(content, attrs_at.start + 2, attrs_at.header + attrs_at.length - 1)"))
    return joined.select("blob", "signer", F.hex(raw("issuer_at")).alias("issuer"), "serial", _named(DIGESTS, F.col("digest_oid")).alias("digest"), F.when(F.col("algorithm_oid") == RSA, "RSA").otherwise(_named({k: f"RSA with {v}" for k, v in SIGNED_WITH.items()}, F.col("algorithm_oid"))).alias("algorithm"), "message_digest", F.try_to_timestamp("signing_time").alias("signing_time"), covered.alias("signed_attributes"), "signature", raw("stamp_at").alias("stamp"))


def names(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """(blob, path, name) of the name nodes ``at`` (blob, path): ``CN=...,O=...`` in the order they are written."""
    rdn = _under(nodes, at.select("blob", F.col("path").alias("name_path")), "name_path", F.col("path").alias("set"), F.col("place").alias("k"))
    pair = _under(nodes, rdn, "set", F.col("path").alias("pair"), F.col("place").alias("j"))
    kind = nodes.where("place = 0 and tag = 6").select("blob", F.col("parent").alias("pair"), F.col("text").alias("oid"))
    said = nodes.where("place = 1").select("blob", F.col("parent").alias("pair"), F.coalesce("text", F.hex("value")).alias("said"))
    parts = pair.join(kind, ["blob", "pair"]).join(said, ["blob", "pair"]).withColumn("part", F.concat_ws("=", _named(NAME_PARTS, F.col("oid")), "said"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "j", "part"))), lambda x: x["part"])
    return parts.groupBy("blob", F.col("name_path").alias("path")).agg(F.array_join(listed, ",").alias("name"))


def certificate_paths(nodes: DataFrame) -> DataFrame:
    """(blob, cert): the certificates in every SignedData, or the blob itself where it is one."""
    inside = _under(nodes, signed_data(nodes).where("certificates is not null").select("blob", "certificates"), "certificates", F.col("path").alias("cert"), "tag", depth=4).where("tag = 16").select("blob", "cert")
    # a certificate: a sequence of two sequences and a bit string
    own = nodes.where("parent = '0'").groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("place") < 2) & (F.col("tag") == 16)).alias("sequences"), F.count_if((F.col("place") == 2) & (F.col("tag") == 3)).alias("bits"))
    return inside.unionByName(own.where("n = 3 and sequences = 2 and bits = 1").select("blob", F.lit("0").alias("cert")))


def certificates(nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """(blob, cert, subject, issuer, subject_raw, issuer_raw, serial, not_before, not_after, algorithm, key_algorithm, modulus, exponent, tbs, signature, fingerprint, is_ca, usage, purposes, ocsp, crl) of every certificate in ``blobs``.

    Raw names and ``serial`` are hex, to be compared; ``modulus`` and ``exponent`` are
    null unless the key is RSA; ``usage`` and ``purposes`` are lists, and so are the
    addresses of ``ocsp`` and ``crl``.
    """
    each = stored(certificate_paths(nodes), "certificates")
    top = _under(nodes, each, "cert", "path", "place", "tag", "value")
    own = top.groupBy("blob", "cert").agg(_first(F.col("place") == 0, "path").alias("tbs"), _first(F.col("place") == 1, "path").alias("signed_with"), F.max(F.when((F.col("place") == 2) & (F.col("tag") == 3), F.expr("substring(value, 2)"))).alias("signature"))
    inner = _under(nodes, own.select("blob", "cert", "tbs"), "tbs", "path", "place", F.col("class").alias("kind"), "tag", "value", "start", "header", "length")
    order = Window.partitionBy("blob", "tbs").orderBy("place")
    inner = inner.withColumn("nth", F.when((F.col("kind") == 0) & (F.col("tag") == 16), F.count_if((F.col("kind") == 0) & (F.col("tag") == 16)).over(order)))
    at = F.struct("start", "header", "length")
    fields = inner.groupBy("blob", "cert").agg(
        F.min_by(F.hex("value"), F.when((F.col("kind") == 0) & (F.col("tag") == 2), F.col("place"))).alias("serial"),
        *(_first(F.col("nth") == k, "path").alias(name) for k, name in ((2, "issuer_path"), (3, "validity"), (4, "subject_path"), (5, "key"))),
        *(_first(F.col("nth") == k, at).alias(name) for k, name in ((2, "issuer_at"), (4, "subject_at"))),
        _first((F.col("kind") == 2) & (F.col("tag") == 3), "path").alias("extended"),
    )
    spans = nodes.select("blob", F.col("path"), at.alias("at"))
    joined = own.join(fields, ["blob", "cert"]).join(spans.select("blob", F.col("path").alias("tbs"), F.col("at").alias("tbs_at")), ["blob", "tbs"]).join(spans.select("blob", F.col("path").alias("cert"), F.col("at").alias("cert_at")), ["blob", "cert"])
    times = nodes.where("tag in (23, 24)").groupBy("blob", F.col("parent").alias("validity")).agg(_first(F.col("place") == 0, "text").alias("not_before"), _first(F.col("place") == 1, "text").alias("not_after"))
    oid = nodes.where("place = 0 and tag = 6").select("blob", "parent", "text")
    joined = joined.join(times, ["blob", "validity"], "left").join(oid.select("blob", F.col("parent").alias("signed_with"), F.col("text").alias("signed_oid")), ["blob", "signed_with"], "left")
    keys = nodes.where("place = 0 and tag = 16").select("blob", F.col("parent").alias("key"), F.col("path").alias("key_kind")).join(oid.select("blob", F.col("parent").alias("key_kind"), F.col("text").alias("key_oid")), ["blob", "key_kind"]).drop("key_kind")
    bits = nodes.where("place = 1 and tag = 3").select("blob", F.col("parent").alias("key"), F.expr("substring(value, 2)").alias("bits"))
    joined = joined.join(keys, ["blob", "key"], "left").join(bits, ["blob", "key"], "left").join(blobs.select("blob", F.col("content")), "blob")
    raw = lambda c: raw_of(F.col("content"), F.col(f"{c}.start"), F.col(f"{c}.header"), F.col(f"{c}.length"))
    facts = joined.select("blob", "cert", "serial", "issuer_path", "subject_path", F.hex(raw("issuer_at")).alias("issuer_raw"), F.hex(raw("subject_at")).alias("subject_raw"), F.try_to_timestamp("not_before").alias("not_before"), F.try_to_timestamp("not_after").alias("not_after"), _named({k: f"RSA with {v}" for k, v in SIGNED_WITH.items()}, F.col("signed_oid")).alias("algorithm"), F.when(F.col("key_oid") == RSA, "RSA").otherwise(F.col("key_oid")).alias("key_algorithm"), F.when(F.col("key_oid") == RSA, F.col("bits")).alias("bits"), raw("tbs_at").alias("tbs"), "signature", F.sha2(raw("cert_at"), 256).alias("fingerprint"), "extended")
    facts = stored(facts, "certificates")

    # RSA keys and extension values are DER of their own
    parts = facts.where("bits is not null").select(F.concat_ws("|", "blob", "cert").alias("blob"), F.col("bits").alias("content"))
    numbers = der_nodes(parts).where("parent = '0' and tag = 2").groupBy("blob").agg(F.max(F.when(F.col("place") == 0, F.col("value"))).alias("modulus"), F.max(F.when(F.col("place") == 1, F.col("value"))).alias("exponent"))
    extras = _extensions(nodes, facts.where("extended is not null").select("blob", "cert", "extended"))
    whole = F.concat_ws("|", F.col("blob"), F.col("cert"))
    out = facts.withColumn("id", whole).join(numbers.withColumnRenamed("blob", "id"), "id", "left").join(extras.withColumnRenamed("blob", "id"), "id", "left")
    name_at = facts.select("blob", F.explode(F.array("issuer_path", "subject_path")).alias("path")).where("path is not null").distinct()
    said = stored(names(nodes, name_at), "names")
    for side in ("issuer", "subject"):
        out = out.join(said.select("blob", F.col("path").alias(f"{side}_path"), F.col("name").alias(side)), ["blob", f"{side}_path"], "left")
    none = F.array().cast("array<string>")
    return out.select("blob", "cert", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("issuer", F.lit("")).alias("issuer"), "subject_raw", "issuer_raw", "serial", "not_before", "not_after", "algorithm", "key_algorithm", "modulus", "exponent", "tbs", "signature", "fingerprint", F.coalesce("is_ca", F.lit(False)).alias("is_ca"), *(F.coalesce(c, none).alias(c) for c in ("usage", "purposes", "ocsp", "crl")))


def _extensions(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """(blob, is_ca, usage, purposes, ocsp, crl) by the extensions under ``at`` (blob, cert, extended), blob being ``blob|cert``."""
    lists = _under(nodes, at, "extended", F.col("path").alias("list"))
    each = _under(nodes, lists, "list", F.col("path").alias("extension"))
    named = each.join(nodes.where("place = 0 and tag = 6").select("blob", F.col("parent").alias("extension"), F.col("text").alias("oid")), ["blob", "extension"]).where(F.col("oid").isin(KEY_USAGE, CONSTRAINTS, POINTS, ACCESS, PURPOSES))
    values = named.join(nodes.where("class = 0 and tag = 4").select("blob", F.col("parent").alias("extension"), "value"), ["blob", "extension"])
    inner = der_nodes(values.select(F.concat_ws("|", "blob", "cert", "oid").alias("blob"), F.col("value").alias("content")))
    inner = stored(inner.withColumn("of", F.substring_index("blob", "|", -1)), "extensions")
    owner = F.expr("substring(blob, 1, length(blob) - length(of) - 1)").alias("blob")
    first = F.conv(F.hex(F.expr("substring(value, 2, 1)")), 16, 10).cast("int")
    second = F.coalesce(F.conv(F.hex(F.expr("substring(value, 3, 1)")), 16, 10).cast("int"), F.lit(0))
    uses = F.filter(F.array(*(F.when(F.shiftright(first * 256 + second, 15 - k) % 2 == 1, use) for k, use in enumerate(USES))), lambda u: u.isNotNull())
    url = (F.col("class") == 2) & (F.col("tag") == 6) & ~F.col("constructed")
    kinds = inner.where("place = 0 and class = 0 and tag = 6").select(F.col("blob"), F.col("parent"), F.col("text").alias("method"))
    rows = inner.join(kinds, ["blob", "parent"], "left")
    address = F.decode("value", "ISO-8859-1")
    return rows.groupBy(owner).agg(
        F.coalesce(F.max(F.when((F.col("of") == CONSTRAINTS) & (F.col("tag") == 1), F.col("text") == "true")), F.lit(False)).alias("is_ca"),
        F.max(F.when((F.col("of") == KEY_USAGE) & (F.col("tag") == 3), uses)).alias("usage"),
        F.array_sort(F.collect_set(F.when((F.col("of") == PURPOSES) & (F.col("tag") == 6), F.col("text")))).alias("purposes"),
        F.array_sort(F.collect_set(F.when((F.col("of") == ACCESS) & (F.col("method") == OCSP) & url, address))).alias("ocsp"),
        F.array_sort(F.collect_set(F.when((F.col("of") == POINTS) & url, address))).alias("crl"),
    )


def rsa_matches(message: Column, signature: Column, modulus: Column, exponent: Column, digest: Column) -> Column:
    """Whether ``signature`` is the RSA signature (PKCS #1, block type 1) of ``message`` under ``digest``; null where anything is missing or the digest unknown."""
    known = {name: (bytes.fromhex("06%02x" % len(raw)) + raw) for oid, name in DIGESTS.items() for raw in [_oid_bytes(oid)]}
    makers = {"MD5": hashlib.md5, "SHA-1": hashlib.sha1, "SHA-256": hashlib.sha256, "SHA-384": hashlib.sha384, "SHA-512": hashlib.sha512}

    @F.pandas_udf("boolean")
    def check(message: pd.Series, signature: pd.Series, modulus: pd.Series, exponent: pd.Series, digest: pd.Series) -> pd.Series:
        out = []
        for m, s, n, e, d in zip(message, signature, modulus, exponent, digest):
            if any(x is None for x in (m, s, n, e)) or d not in known:
                out.append(None)
                continue
            n, e, size = int.from_bytes(n, "big"), int.from_bytes(e, "big"), len(bytes(n).lstrip(b"\0"))
            if n < 3 or e > 1 << 64 or size > 2048:  # no key of this kind
                out.append(False)
                continue
            block = pow(int.from_bytes(s, "big"), e, n).to_bytes(size, "big")
            hashed = makers[d](bytes(m)).digest()
            ends = []
            for tail in (b"\x05\x00", b""):
                kind = b"\x30" + bytes([len(known[d]) + len(tail)]) + known[d] + tail
                info = kind + b"\x04" + bytes([len(hashed)]) + hashed
                ends.append(b"\x30" + bytes([len(info)]) + info)
            out.append(any(block == b"\0\1" + b"\xff" * (size - 3 - len(end)) + b"\0" + end and size >= len(end) + 11 for end in ends))
        return pd.Series(out, dtype=object)

    return check(message, signature, modulus, exponent, digest)


def _oid_bytes(text: str) -> bytes:
    parts = list(map(int, text.split(".")))
    out = bytearray()
    for n in (parts[0] * 40 + parts[1], *parts[2:]):
        group = [n & 127]
        while n := n >> 7:
            group.append(n & 127 | 128)
        out += bytes(reversed(group))
    return bytes(out)


def digest_of(message: Column, digest: Column) -> Column:
    """The digest of ``message`` in upper-case hex by the digest's name, null if it is unknown."""
    sha = lambda n: F.upper(F.sha2(message, n))
    return F.when(digest == "MD5", F.upper(F.md5(message))).when(digest == "SHA-1", F.upper(F.sha1(message))).when(digest == "SHA-256", sha(256)).when(digest == "SHA-384", sha(384)).when(digest == "SHA-512", sha(512))


def chains(certs: DataFrame, leaves: DataFrame, anchors: DataFrame, most: int = 10) -> DataFrame:
    """(blob, leaf, step, cert, subject, status) along the issuers of every leaf (blob, cert, at).

    From a certificate the chain goes on to one of the same blob whose raw subject is its
    raw issuer, one valid at ``at`` before others, then by fingerprint. ``status`` is null
    while it goes on; the last step says ``trusted`` (self-issued and among ``anchors``
    (fingerprint), or issued by one: an anchor's raw subject), ``untrusted`` (self-issued
    and not among them), ``gap`` (no issuer here), ``loop`` (the issuer was passed
    already), ``too long`` (beyond ``most`` certificates), ``expired`` or ``not yet
    valid`` (at ``at``; it ends there), ``forged`` (its signature does not fit its
    issuer's RSA key). All leaves go on together, a step a round; no round sees the
    certificates of more than one blob in a row.
    """
    own = certs.select("blob", "cert", "subject", "subject_raw", "issuer_raw", "not_before", "not_after", "fingerprint", "modulus", "exponent", "tbs", "signature", F.replace("algorithm", F.lit("RSA with "), F.lit("")).alias("digest"))
    own = stored(own, "chain")
    trusted = anchors.select(F.col("fingerprint"), F.lit(True).alias("is_anchor")).distinct()
    roots = anchors.select(F.col("subject_raw").alias("issuer_raw"), F.lit(True).alias("anchored")).distinct()
    start = leaves.select("blob", F.col("cert").alias("leaf"), "cert", "at").join(own, ["blob", "cert"])
    level = start.withColumn("step", F.lit(0)).withColumn("passed", F.array("fingerprint"))
    done = []
    while True:
        level = stored(level, "chain")
        if level.isEmpty():
            break
        step = done[-1]._step + 1 if done else 0
        state = level.join(F.broadcast(trusted), "fingerprint", "left").join(F.broadcast(roots), "issuer_raw", "left")
        issuer = own.select("blob", F.col("subject_raw").alias("issuer_raw"), F.struct("cert", "subject", "subject_raw", F.col("issuer_raw").alias("of"), "not_before", "not_after", "fingerprint", "modulus", "exponent", "tbs", "signature", "digest").alias("issuer"))
        valid = (F.col("issuer.not_before") <= F.col("at")) & (F.col("at") <= F.col("issuer.not_after"))
        best = state.select("blob", "leaf", "at", "issuer_raw", "subject_raw").where("issuer_raw <> subject_raw").join(issuer, ["blob", "issuer_raw"]).groupBy("blob", "leaf").agg(F.min_by("issuer", F.struct(~F.coalesce(valid, F.lit(False)), F.col("issuer.fingerprint"))).alias("issuer"))
        joined = state.join(best, ["blob", "leaf"], "left")
        fits = rsa_matches(F.col("tbs"), F.col("signature"), F.coalesce("issuer.modulus", F.when(F.col("issuer_raw") == F.col("subject_raw"), F.col("modulus"))), F.coalesce("issuer.exponent", F.when(F.col("issuer_raw") == F.col("subject_raw"), F.col("exponent"))), F.col("digest"))
        joined = joined.withColumn("fits", fits)
        status = (
            F.when(F.col("at") > F.col("not_after"), "expired")
            .when(F.col("at") < F.col("not_before"), "not yet valid")
            .when(~F.col("fits"), "forged")
            .when(F.col("is_anchor"), "trusted")
            .when(F.col("issuer_raw") == F.col("subject_raw"), "untrusted")
            .when(F.col("issuer").isNull() & F.col("anchored"), "trusted")
            .when(F.col("issuer").isNull(), "gap")
            .when(F.array_contains("passed", F.col("issuer.fingerprint")), "loop")
            .when(F.lit(step + 1 >= most), "too long")
        )
        found = stored(joined.withColumn("status", status), "chain")
        found._step = step
        done.append(found)
        going = found.where("status is null")
        forget(level)
        level = going.select("blob", "leaf", F.col("issuer.cert").alias("cert"), "at", F.col("issuer.subject").alias("subject"), F.col("issuer.subject_raw").alias("subject_raw"), F.col("issuer.of").alias("issuer_raw"), *(F.col(f"issuer.{c}").alias(c) for c in ("not_before", "not_after", "fingerprint", "modulus", "exponent", "tbs", "signature", "digest")), (F.col("step") + 1).alias("step"), F.concat("passed", F.array("issuer.fingerprint")).alias("passed"))
    columns = ["blob", "leaf", "step", "cert", "subject", "status"]
    out = done[0].select(*columns) if done else level.select("blob", "leaf", "step", "cert", "subject", F.lit(None).cast("string").alias("status"))
    for more in done[1:]:
        out = out.unionByName(more.select(*columns))
    return out


def verified(blobs: DataFrame, signed: DataFrame) -> DataFrame:
    """(blob, signer, certificate, digest_ok, signature_ok, status) of every signer of ``blobs`` (blob, content) over ``signed`` (blob, message).

    The message's digest must be the signed attribute's (or the signature must cover the
    message itself where nothing is signed beside it), and the signature must fit the RSA
    key of the certificate with the signer's issuer and serial. A blob without a signer
    has one row with status ``SignatureFormatError``; other statuses are ``Valid``,
    ``DigestMismatch``, ``Invalid``, ``CertificateMissing`` and ``Unsupported``.
    """
    nodes = stored(der_nodes(blobs), "der")
    mine = stored(signers(nodes, blobs), "signers")
    keys = certificates(nodes, blobs).select("blob", F.col("issuer_raw").alias("issuer"), "serial", F.col("cert").alias("certificate"), "modulus", "exponent")
    one = keys.groupBy("blob", "issuer", "serial").agg(F.min(F.struct("certificate", "modulus", "exponent")).alias("k")).select("blob", "issuer", "serial", "k.*")
    joined = mine.join(one, ["blob", "issuer", "serial"], "left").join(signed.select("blob", "message"), "blob", "left")
    covered = F.coalesce("signed_attributes", "message")
    digest_ok = F.when(F.col("signed_attributes").isNull(), True).otherwise(F.coalesce(F.hex("message_digest") == digest_of(F.col("message"), F.col("digest")), F.lit(False)))
    checked = joined.withColumn("digest_ok", digest_ok).withColumn("signature_ok", rsa_matches(covered, F.col("signature"), F.col("modulus"), F.col("exponent"), F.col("digest")))
    status = F.when(F.col("certificate").isNull(), "CertificateMissing").when(F.col("signature_ok").isNull(), "Unsupported").when(~F.col("signature_ok"), "Invalid").when(~F.col("digest_ok"), "DigestMismatch").otherwise("Valid")
    found = checked.select("blob", "signer", "certificate", "digest_ok", "signature_ok", status.alias("status"))
    rest = blobs.select("blob").join(mine.select("blob").distinct(), "blob", "left_anti")
    return found.unionByName(rest.select("blob", F.lit(None).cast("string").alias("signer"), F.lit(None).cast("string").alias("certificate"), F.lit(None).cast("boolean").alias("digest_ok"), F.lit(None).cast("boolean").alias("signature_ok"), F.lit("SignatureFormatError").alias("status")))


def stamps(tokens: DataFrame) -> DataFrame:
    """(blob, time, policy, digest, imprint, seconds, millis, micros) of time-stamp tokens or their bare info (blob, content): what was stamped, when, how exactly."""
    nodes = stored(der_nodes(tokens), "der")
    held = signed_data(nodes).where(F.col("content_type") == STAMP_INFO).select("blob", "content")
    bare = tokens.select("blob", "content").join(nodes.where("path = '0.0' and tag = 2").select("blob"), "blob", "left_semi")
    info = stored(der_nodes(held.unionByName(bare)), "stamps")
    top = info.where("parent = '0'").groupBy("blob").agg(
        _first((F.col("tag") == 24) & (F.col("class") == 0), "text").alias("time"),
        _first(F.col("place") == 1, "text").alias("policy"),
        _first(F.col("place") == 2, "path").alias("hashed"),
        _first((F.col("class") == 0) & (F.col("tag") == 16) & (F.col("place") > 4), "path").alias("accuracy"),
    )
    kind = info.where("tag = 6 and path like '0.2.0.%'").select("blob", F.col("text").alias("oid"))
    imprint = info.where("tag = 4 and parent = '0.2'").select("blob", F.col("value").alias("imprint"))
    number = F.conv(F.hex("value"), 16, 10).try_cast("int")
    exact = info.groupBy("blob", F.col("parent").alias("accuracy")).agg(F.max(F.when((F.col("class") == 0) & (F.col("tag") == 2), number)).alias("seconds"), F.max(F.when((F.col("class") == 2) & (F.col("tag") == 0), number)).alias("millis"), F.max(F.when((F.col("class") == 2) & (F.col("tag") == 1), number)).alias("micros"))
    joined = top.join(kind, "blob", "left").join(imprint, "blob", "left").join(exact, ["blob", "accuracy"], "left").where("time is not null")
    return joined.select("blob", F.try_to_timestamp("time").alias("time"), "policy", _named(DIGESTS, F.col("oid")).alias("digest"), "imprint", "seconds", "millis", "micros")

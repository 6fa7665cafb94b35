"""Signed blobs: DER rows against a hand-built tree, blobs of another writer, hostile bytes, chains of every end."""

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import signatures as S
from quire.sources import der

HERE = os.path.join(os.path.dirname(__file__), "vectors")


def vector(name):
    with open(os.path.join(HERE, f"{name}.b64")) as f:
        return base64.b64decode(f.read())


def blobs_of(spark, **content):
    return spark.createDataFrame([(k, v) for k, v in content.items()], "blob string, content binary")


def test_der_rows_equal_a_hand_built_tree():
    data = der.sequence(der.integer(-5 & 0xFF), der.oid("1.2.840.113549.1.7.2"), der.tlv(0xA0, der.tlv(12, "é".encode()), der.tlv(0x31)), der.moment("491231235959"), der.moment("500101000000"), der.tlv(4, b"x" * 200)) + b"behind"
    rows = S.der_walk(data)
    assert [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows] == [
        ("0", None, 0, 0, 0, True, 16),
        ("0.0", "0", 0, 1, 0, False, 2),
        ("0.1", "0", 1, 1, 0, False, 6),
        ("0.2", "0", 2, 1, 2, True, 0),
        ("0.2.0", "0.2", 0, 2, 0, False, 12),
        ("0.2.1", "0.2", 1, 2, 0, True, 17),
        ("0.3", "0", 3, 1, 0, False, 23),
        ("0.4", "0", 4, 1, 0, False, 23),
        ("0.5", "0", 5, 1, 0, False, 4),
    ]
    assert [r[11] for r in rows] == [None, "251", "1.2.840.113549.1.7.2", None, "é", None, "2049-12-31 23:59:59", "1950-01-01 00:00:00", None]
    last = rows[-1]
    assert data[last[7] : last[7] + last[8] + last[9]] == der.tlv(4, b"x" * 200) and last[10] == b"x" * 200
    endless = b"\x30\x80\x02\x01\x05\x24\x80\x04\x01a\x00\x00\x00\x00rest"
    assert [(r[0], r[6], r[10]) for r in S.der_walk(endless)] == [("0", 16, None), ("0.0", 2, b"\x05"), ("0.1", 4, None), ("0.1.0", 4, b"a")]


@pytest.mark.parametrize("data, says", [(b"", "a value without length"), (b"\x30", "a value without length"), (b"\x30\x05\x02", "a value beyond its parent"), (b"\x30\x85" + b"\xff" * 5, "a length of too many bytes"), (b"\x04\x80", "a primitive value without length"), (b"\x30\x80" * 100, "nested too deeply"), (b"\x1f\xff\xff", "a long tag without end")])
def test_bytes_that_do_not_fit_end_the_walk(data, says):
    assert S.der_walk(data)[-1][6:7] + S.der_walk(data)[-1][11:] == (-1, says)


def test_walks_of_damaged_blobs_end():
    r = random.Random(1)
    whole = vector("detached_sha512")
    for _ in range(400):
        data = bytearray(whole)
        for _ in range(r.randrange(1, 6)):
            data[r.randrange(len(data))] = r.randrange(256)
        assert S.der_walk(bytes(data[: r.randrange(len(data))]))


def test_blobs_of_another_writer(spark):
    blobs = blobs_of(spark, detached=vector("detached_sha512"), plain=vector("enclosed_no_attributes_sha1"), endless=vector("enclosed_indefinite_sha256"), junk=b"no blob at all", none=None)
    nodes = S.der_nodes(blobs)
    certs = {(c.blob, c.serial): c for c in S.certificates(nodes, blobs).collect()}
    leaf = certs["detached", "00ABCDEF01"]
    assert (leaf.subject, leaf.issuer) == ("CN=Léa Müller,E=lea@example.org", "C=XX,O=Test Root,CN=Root One")
    assert (leaf.algorithm, leaf.key_algorithm, leaf.is_ca, leaf.usage, leaf.purposes) == ("RSA with SHA-384", "RSA", False, ["Digital Signature"], ["1.3.6.1.5.5.7.3.4"])
    assert (leaf.ocsp, leaf.crl) == (["http://ocsp.example.org/a"], ["http://crl.example.org/b.crl"])
    assert sum(c.is_ca for c in certs.values()) == 1 and len(certs) == 4
    assert {s.blob: s.content and bytes(s.content) for s in S.signed_data(nodes).collect()} == {"plain": b"signed words", "detached": None, "endless": None}
    found = {s.blob: s for s in S.signers(nodes, blobs).collect()}
    assert {k: (s.digest, s.serial) for k, s in found.items()} == {"detached": ("SHA-512", "00ABCDEF01"), "plain": ("SHA-1", "00ABCDEF01"), "endless": ("SHA-256", "00ABCDEF01")}
    assert found["plain"].signed_attributes is None and found["detached"].signing_time is not None

    def status(message):
        signed = blobs.select("blob", F.lit(message).alias("message"))
        return {r.blob: r.status for r in S.verified(blobs, signed).collect()}

    good = status(b"signed words")
    assert good == {"detached": "Valid", "plain": "Valid", "endless": "Valid", "junk": "SignatureFormatError", "none": "SignatureFormatError"}
    assert {k: v for k, v in status(b"other words").items() if k in found} == {"detached": "DigestMismatch", "plain": "Invalid", "endless": "DigestMismatch"}


def test_a_chain_of_another_writer(spark):
    blobs = blobs_of(spark, detached=vector("detached_sha512"))
    root = blobs_of(spark, root=vector("root_certificate"))
    certs, anchors = S.certificates(S.der_nodes(blobs), blobs), S.certificates(S.der_nodes(root), root)
    leaf = certs.where("not is_ca").select("blob", "cert", F.current_timestamp().alias("at"))
    assert [(r.step, r.status) for r in S.chains(certs, leaf, anchors).orderBy("step").collect()] == [(0, None), (1, "trusted")]
    assert [(r.step, r.status) for r in S.chains(certs, leaf, anchors.limit(0)).orderBy("step").collect()] == [(0, None), (1, "untrusted")]
    assert [r.status for r in S.chains(certs, leaf.withColumn("at", F.lit("2001-01-01").cast("timestamp")), anchors).collect()] == ["not yet valid"]
    alone = certs.where("not is_ca")  # the root is not in the blob, but its name is an anchor's
    assert [r.status for r in S.chains(alone, leaf, anchors).collect()] == ["trusted"]
    other = anchors.withColumn("modulus", F.reverse("modulus"))
    swapped = certs.where("not is_ca").unionByName(certs.where("is_ca").withColumn("modulus", F.lit(b"\x7f" + b"\x01" * 128)))
    assert [r.status for r in S.chains(swapped, leaf, other).collect()] == ["forged"]
    assert S.chains(certs, leaf.limit(0), anchors).count() == 0


def test_long_chains_and_loops(spark):
    key = der.rsa_key("k")
    who = [der.name(CN=f"N{k}") for k in range(14)]
    cert = lambda k, by: der.certificate(who[k], who[by], k + 1, "200101000000", "400101000000", key, key, k > 0)
    line = der.signed_data(b"m", [cert(k, k + 1) for k in range(13)], who[1], 1, key, "250101000000")
    ring = der.signed_data(b"m", [cert(0, 1), cert(1, 2), cert(2, 1)], who[1], 1, key, "250101000000")
    blobs = blobs_of(spark, line=line, ring=ring)
    certs = S.certificates(S.der_nodes(blobs), blobs)
    leaf = certs.where("serial = '01'").select("blob", "cert", F.lit("2025-06-01").cast("timestamp").alias("at"))
    ends = {r.blob: (r.step, r.status) for r in S.chains(certs, leaf, certs.limit(0)).where("status is not null").collect()}
    assert ends == {"line": (9, "too long"), "ring": (2, "loop")}


def test_time_stamps_of_another_writer(spark):
    import hashlib

    (got,) = S.stamps(blobs_of(spark, token=vector("time_stamp"), junk=b"\x30\x03\x02\x01\x05")).collect()
    assert (got.blob, got.policy, got.digest, bytes(got.imprint)) == ("token", "1.2.3.4.1", "SHA-256", hashlib.sha256(b"signed words").digest())
    assert (got.seconds, got.millis, got.micros) == (1, 500, 100) and got.time is not None


def test_unsupported_keys_and_missing_certificates(spark):
    key = der.rsa_key("k")
    me = der.name(CN="Me")
    mine = der.certificate(me, me, 5, "200101000000", "400101000000", key, key)
    blobs = blobs_of(spark, missing=der.signed_data(b"m", [], me, 5, key, "250101000000"), other=der.signed_data(b"m", [mine.replace(der.oid(S.RSA), der.oid("1.2.840.113549.1.1.9"))], me, 5, key, "250101000000"), fine=der.signed_data(b"m", [mine], me, 5, key, "250101000000"))
    got = {r.blob: r.status for r in S.verified(blobs, blobs.select("blob", F.lit(b"m").alias("message"))).collect()}
    assert got == {"missing": "CertificateMissing", "other": "Unsupported", "fine": "Valid"}

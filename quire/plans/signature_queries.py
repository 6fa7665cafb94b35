"""Registered queries over signed statements of all suppliers; SQL tells from the keys what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import signatures
from ..sources import der
from ..sources.bridge import table
from ..sources.shared import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AT = "2025-06-01 00:00:00"

ALL = """WITH s AS (SELECT s_suppkey, s_name, n_nationkey AS nation, n_name, r_name, concat(s_name, '|', printf('%.2f', s_acctbal)) AS message, s_suppkey % 5 = 1 AS ended, s_suppkey % 5 = 2 AS gap, s_suppkey % 5 = 3 AS changed, s_suppkey % 7 = 0 AS broken, n_nationkey % 6 = 5 AS crossed
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql.replace("@all", ALL)
        return fn

    return add


def _blobs(spark, d) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    sellers = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return stored(der.seller_blobs(sellers), "blobs")


def _parsed(spark, d) -> tuple[DataFrame, DataFrame]:
    blobs = _blobs(spark, d)
    return blobs, stored(signatures.der_nodes(blobs), "der")


def number():
    return F.col("blob").cast("long").alias("s_suppkey")


@_register("@all SELECT s_suppkey, concat('CN=', n_name, ',O=', r_name) AS issuer, CAST(s_suppkey + 100 AS BIGINT) AS serial, 'SHA-256' AS digest, sha256(message) AS message_digest, make_timestamp(2025, 1, 1 + s_suppkey % 28, 12, 0, 0) AS signing_time, s_suppkey % 3 = 0 AS stamped FROM s")
def cms_signers(spark, d):
    blobs, nodes = _parsed(spark, d)
    certs = signatures.certificates(nodes, blobs).select("blob", F.col("issuer_raw").alias("raw"), "serial", F.col("issuer").alias("said"))
    found = signatures.signers(nodes, blobs).join(certs.withColumnRenamed("raw", "issuer"), ["blob", "issuer", "serial"])
    return found.select(number(), F.col("said").alias("issuer"), F.conv("serial", 16, 10).cast("long").alias("serial"), "digest", F.lower(F.hex("message_digest")).alias("message_digest"), "signing_time", F.col("stamp").isNotNull().alias("stamped"))


@_register("""@all SELECT s_suppkey, concat('CN=', s_name, ',O=', n_name) AS subject, false AS is_ca, 'Digital Signature,Non Repudiation' AS usage, concat('http://ocsp.example/', nation) AS ocsp, concat('http://crl.example/', replace(r_name, ' ', '-'), '.crl') AS crl, CASE WHEN ended THEN 2000 ELSE 2040 END AS last_year FROM s
 UNION ALL SELECT s_suppkey, concat('CN=', n_name, ',O=', r_name), true, 'Key Cert Sign,CRL Sign', '', '', 2040 FROM s WHERE NOT gap
 UNION ALL SELECT s_suppkey, concat('CN=', r_name, ',O=Roots'), true, 'Key Cert Sign,CRL Sign', '', '', 2040 FROM s WHERE NOT crossed
 UNION ALL SELECT s_suppkey, concat('CN=Cross ', n_name), true, 'Key Cert Sign,CRL Sign', '', '', 2040 FROM s WHERE crossed""")
def certificate_facts(spark, d):
    blobs, nodes = _parsed(spark, d)
    certs = signatures.certificates(nodes, blobs)
    return certs.select(number(), "subject", "is_ca", F.array_join("usage", ",").alias("usage"), F.array_join("ocsp", ",").alias("ocsp"), F.array_join("crl", ",").alias("crl"), F.year("not_after").alias("last_year"))


def _roots(blobs: DataFrame) -> DataFrame:
    roots = stored(blobs.select(F.sha2("root", 256).alias("blob"), F.col("root").alias("content")).distinct(), "roots")
    return signatures.certificates(stored(signatures.der_nodes(roots), "der"), roots).select("fingerprint", "subject_raw")


@_register("""@all, n AS (SELECT *, concat('CN=', n_name, ',O=', r_name) AS middle FROM s)
 SELECT s_suppkey, 0 AS step, concat('CN=', s_name, ',O=', n_name) AS subject, CASE WHEN ended THEN 'expired' WHEN gap THEN 'gap' END AS status FROM n
 UNION ALL SELECT s_suppkey, 1, middle, NULL FROM n WHERE NOT ended AND NOT gap
 UNION ALL SELECT s_suppkey, 2, CASE WHEN crossed THEN concat('CN=Cross ', n_name) ELSE concat('CN=', r_name, ',O=Roots') END, CASE WHEN crossed THEN 'loop' ELSE 'trusted' END FROM n WHERE NOT ended AND NOT gap""")
def certificate_chains(spark, d):
    """From every seller's certificate (the one that the signer names) to a root, at one moment."""
    blobs, nodes = _parsed(spark, d)
    certs = stored(signatures.certificates(nodes, blobs), "certificates")
    signer = signatures.signers(nodes, blobs).select("blob", F.col("issuer").alias("issuer_raw"), "serial")
    leaves = certs.join(signer, ["blob", "issuer_raw", "serial"]).select("blob", "cert", F.lit(AT).cast("timestamp").alias("at"))
    return signatures.chains(certs, leaves, _roots(blobs)).select(number(), "step", "subject", "status")


@_register("@all SELECT s_suppkey, NOT changed AS digest_ok, NOT broken AS signature_ok, CASE WHEN broken THEN 'Invalid' WHEN changed THEN 'DigestMismatch' ELSE 'Valid' END AS status FROM s")
def signature_checks(spark, d):
    blobs = _blobs(spark, d)
    return signatures.verified(blobs, blobs.select("blob", "message")).select(number(), "digest_ok", "signature_ok", "status")


@_register("@all SELECT s_suppkey, TIMESTAMP '2025-01-02 03:04:05' AS time, '1.3.6.1.4.1.99999.1' AS policy, 'SHA-256' AS digest, sha256(message) AS imprint, CAST(1 + s_suppkey % 9 AS INT) AS seconds, 5 AS millis FROM s WHERE s_suppkey % 3 = 0")
def time_stamps(spark, d):
    blobs, nodes = _parsed(spark, d)
    tokens = signatures.signers(nodes, blobs).where("stamp is not null").select("blob", F.col("stamp").alias("content"))
    return signatures.stamps(tokens).select(number(), "time", "policy", "digest", F.lower(F.hex("imprint")).alias("imprint"), "seconds", "millis")

"""Registered queries over forms, profiles, sounds, validation data, inline images and fonts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forms_media
from ..sources.bridge import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return add


@_register("SELECT p_partkey, CAST(p_partkey + 128 AS BIGINT) AS size, CASE WHEN p_size % 2 = 0 THEN '4.2' ELSE '2.1' END AS version, 'mntr' AS device_class, CASE WHEN p_size % 3 = 0 THEN 'CMYK' ELSE 'RGB' END AS color_space FROM part WHERE p_partkey % 5 <> 0")
def color_profiles(spark, d):
    version = F.when(F.col("p_size") % 2 == 0, "04200000").otherwise("02100000")
    space = F.when(F.col("p_size") % 3 == 0, "434D594B").otherwise("52474220")
    mark = F.when(F.col("p_partkey") % 5 == 0, "00000000").otherwise("61637370")
    text = F.concat(F.lpad(F.hex(F.col("p_partkey") + 128), 8, "0"), F.lit("00" * 4), version, F.lit("6D6E7472"), space, F.lit("58595A20"), F.lit("00" * 12), mark, F.lit("00" * 88))
    parts = table(spark, d, "part").select("p_partkey", forms_media.profile_header(F.unhex(text)).alias("h")).where("h is not null")
    return parts.select("p_partkey", "h.size", "h.version", "h.device_class", "h.color_space")


@_register("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'WAV' WHEN 1 THEN 'MP3' WHEN 2 THEN 'OGG' WHEN 3 THEN 'FLAC' END AS sound FROM events")
def sound_formats(spark, d):
    lead = F.element_at(F.array(*map(F.lit, ("RIFFxxxx", "ID3x", "OggSx", "fLaCx", "none"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", forms_media.leading_format(F.encode(F.concat(lead, F.col("props")), "UTF-8"), forms_media.SOUNDS).alias("sound"))


@_register("SELECT p_partkey AS doc_id, CAST(3 + p_size % 4 AS BIGINT) AS n_elements, CAST(p_size % 4 + (p_size % 2 = 0)::INT AS BIGINT) AS n_scripts FROM part")
def template_scripts(spark, d):
    body = F.concat(F.lit("<template><subform"), F.when(F.col("p_size") % 2 == 0, ' runAt="client"').otherwise(""), F.lit("><field/>"), F.repeat(F.lit("<xfa:script>x()</xfa:script>"), (F.col("p_size") % 4).cast("int")), F.lit("</subform></template>"))
    return forms_media.script_counts(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), body.alias("xml")))


@_register("WITH o AS (SELECT c_nationkey, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey), f AS (SELECT c_nationkey AS form, count(*) AS n, 0 AS leaf, 0 AS sig FROM customer GROUP BY 1), w AS (SELECT c_nationkey AS form, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS sig FROM o GROUP BY 1), e AS (SELECT c_nationkey AS form, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1) SELECT f.form, f.n + coalesce(w.n, 0) AS n_fields, coalesce(w.n, 0) + coalesce(e.n, 0) AS n_leaves, coalesce(w.sig, 0) AS n_signatures FROM f LEFT JOIN w ON f.form = w.form LEFT JOIN e ON f.form = e.form")
def form_fields(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    top = customers.select(F.col("c_nationkey").alias("form"), F.concat(F.lit("c"), F.col("c_custkey")).alias("field"), F.lit(None).cast("string").alias("parent"), F.lit("Tx").alias("kind"))
    under = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("form"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("field"), F.concat(F.lit("c"), F.col("o_custkey")).alias("parent"), F.when(F.col("o_orderstatus") == "P", "Sig").otherwise("Tx").alias("kind"))
    return forms_media.field_counts(top.unionByName(under))


@_register("SELECT s_suppkey AS doc_id, CAST(s_suppkey % 4 AS BIGINT) AS n_certs, CAST(s_suppkey % 3 AS BIGINT) AS n_ocsps, CAST(0 AS BIGINT) AS n_crls, s_suppkey % 12 <> 0 AS has_any FROM supplier")
def validation_data(spark, d):
    some = lambda n: F.array_repeat(F.lit("1 0 R"), (F.col("s_suppkey") % n).cast("int"))
    stores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.to_json(F.struct(some(4).alias("Certs"), some(3).alias("OCSPs"))).alias("value"))
    return forms_media.validation_data(stores)


@_register("SELECT p_partkey AS doc_id, CAST(unnest([0, 1]) AS INT) AS place, CAST(unnest([p_size, 8]) AS INT) AS width, CAST(unnest([p_size + 1, 9]) AS INT) AS height, CAST(unnest([8, 1]) AS INT) AS bits, unnest(['DeviceRGB', 'DeviceGray']) AS space FROM part")
def inline_images(spark, d):
    ops = F.format_string("q BI /W %d /H %d /BPC 8 /CS /RGB ID xyz EI Q BI /Width 8 /Height 9 /BitsPerComponent 1 /ColorSpace /G ID z EI", F.col("p_size"), F.col("p_size") + 1)
    return forms_media.inline_images(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), ops.alias("ops")))


@_register("SELECT p_partkey AS doc_id, replace(p_brand, '#', '') AS name, CASE WHEN p_size % 2 = 0 THEN 'TrueType' ELSE 'Type1' END AS subtype, 'StandardEncoding' AS encoding, p_size % 3 = 0 AS embedded FROM part")
def font_inventory(spark, d):
    base = F.concat(F.lit("/ABCDEF+"), F.replace("p_brand", F.lit("#"), F.lit("")))
    value = F.to_json(F.struct(base.alias("BaseFont"), F.when(F.col("p_size") % 2 == 0, "/TrueType").alias("Subtype"), F.when(F.col("p_size") % 3 == 0, "9 0 R").alias("FontFile2")))
    return forms_media.font_inventory(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), value.alias("value")))

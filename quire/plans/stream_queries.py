"""Registered queries over streams and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..operators import findings
from ..sources import export
from ..sources.bridge import document_texts, object_edges, object_nodes, table, text_chunks
from ..streaming import ingest
from . import graph_queries, text_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@_register("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_type_counts(spark, d):
    return ingest.drain(ingest.type_counts(ingest.file_stream(spark, f"{d}/events.parquet")), "complete")


@_register("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    out = ingest.drain(ingest.windowed_counts(ingest.file_stream(spark, f"{d}/events.parquet")), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@_register("SELECT a.user_id AS dst, a.event_id AS src FROM events a WHERE a.event_id % 3 <> 0 AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id % 3 = 0)")
def stream_resolved_references(spark, d):
    """Events refer to their user; a user is known once one of its events divisible by 3 has come."""
    events = ingest.file_stream(spark, f"{d}/events.parquet")
    return ingest.drain(ingest.resolved_references(events.select(F.col("user_id").alias("dst"), F.col("event_id").alias("src"), (F.col("event_id") % 3 == 0).alias("is_target"))))


@_register(f"{text_queries.ALL}, c AS (SELECT doc_id, unnest(generate_series(0, greatest(0, length(text) - 1), 896)) AS o FROM texts) SELECT doc_id, o // 896 AS seq, (doc_id + o // 896) % 13 <> 0 AS intact FROM c")
def chunk_integrity(spark, d):
    chunks = text_chunks(document_texts(spark, d).where("text is not null")).withColumn("crc", F.crc32(F.encode("data", "UTF-8")))
    damaged = chunks.withColumn("data", F.when((F.col("doc_id") + F.col("seq")) % 13 == 0, F.concat("data", F.lit("?"))).otherwise(F.col("data")))
    return ingest.checked_chunks(damaged).select("doc_id", F.col("seq").cast("long").alias("seq"), "intact")


@_register(f"{graph_queries.ALL} SELECT n.node_id, n.node_type, count(e.dst) AS n_edges FROM nodes n LEFT JOIN edges e ON n.node_id = e.src WHERE n.node_type IN ('Catalog', 'Pages', 'Page') GROUP BY ALL")
def export_round_trip(spark, d):
    nodes = object_nodes(spark, d).where(F.col("node_type").isin("Catalog", "Pages", "Page"))
    lines = export.to_json_lines(export.stable_rows(nodes, object_edges(spark, d)))
    through = lines.select(export.cbor_to_json(export.json_to_cbor("value")).alias("value"))
    back = export.load_json_lines(spark, through)
    return back.select("node_id", "node_type", F.size("edges").cast("long").alias("n_edges"))


@_register(f"{text_queries.ALL}, {text_queries.FOUND}, s AS (SELECT doc_id, CAST(least(sum(CASE severity WHEN 'Critical' THEN 100 WHEN 'High' THEN 50 WHEN 'Medium' THEN 20 ELSE 5 END), 1000) AS BIGINT) AS score, string_agg(concat('[', severity, '] ', rule), chr(10) ORDER BY concat('[', severity, '] ', rule)) AS lines FROM found GROUP BY doc_id) SELECT doc_id, concat('score ', score, ' (', CASE WHEN score <= 20 THEN 'LOW' WHEN score <= 100 THEN 'MEDIUM' WHEN score <= 200 THEN 'HIGH' ELSE 'CRITICAL' END, ')', chr(10), lines) AS report FROM s")
def threat_report(spark, d):
    found = findings.threats(document_texts(spark, d).where("text is not null"))
    return export.report_text(findings.risk(found), found)


@_register("SELECT concat('<node><id>', r_regionkey, '</id><name>', r_name, '</name></node>') AS value FROM region")
def xml_export(spark, d):
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return export.to_xml_lines(regions, ["id", "name"]).select(F.regexp_replace("value", r">\s+<", "><").alias("value"))


@_register(f"{graph_queries.ALL} SELECT CASE WHEN obj % 2 = 0 THEN concat(node_id, ':', node_type) ELSE node_id END AS node_id, '1.0.0' AS version FROM nodes WHERE node_type = 'Page'")
def schema_migration(spark, d):
    pages = object_nodes(spark, d).where("node_type = 'Page'")
    return export.migrate(pages.withColumn("version", F.when(F.col("obj") % 2 == 0, "0.9.0").otherwise("1.0.0"))).select("node_id", "version")


@_register("SELECT o_orderkey, upper(o_orderpriority) AS label, length(o_orderpriority) AS n FROM orders")
def plugin_chain(spark, d):
    own = registry.Registry()
    own.register(registry.Plugin("measure", lambda df: df.withColumn("n", F.length("label").cast("long")), needs=("label",)))
    own.register(registry.Plugin("label", lambda df: df.withColumn("label", F.upper("o_orderpriority"))))
    return own.apply(table(spark, d, "orders"), ["measure"]).select("o_orderkey", "label", "n")

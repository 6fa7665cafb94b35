"""Registered queries over streams of documents, their events, and registered health checkers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.health import Checker, Checkers
from ..sources import pdf
from ..sources.bridge import table
from ..sources.shared import ensure_checkpoint_dir
from ..streaming import ingest, pipeline
from .document_queries import ALL, _rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql.replace("@all", ALL)
        return fn

    return add


@_register("""@all SELECT doc_id, 3 + 2 * n_pages + js::BIGINT + 2 * uri::BIGINT + file::BIGINT + revised::BIGINT AS n_objects, CAST(1 AS BIGINT) AS n_issues,
 CAST(len(list_distinct(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 3))) AS BIGINT) AS n_tokens FROM d""")
def stream_pipeline(spark, d):
    """All documents as a stream of files through parsing, rules and index."""
    files = f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    pdf.rendered(table(spark, d, "documents").where("text is not null")).write.parquet(files)
    out = pipeline.run_stages(ingest.file_stream(spark, files, files_per_trigger=4), pipeline.standard_stages())
    count = lambda name, n: out[name].groupBy("doc_id").agg(F.count(F.lit(1)).alias(n))
    joined = count("objects", "n_objects").join(count("issues", "n_issues"), "doc_id", "left").join(count("index", "n_tokens"), "doc_id", "left")
    return joined.select("doc_id", "n_objects", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_issues", "n_tokens")))


@_register("SELECT 'progress' AS event, CAST(count(*) AS BIGINT) AS n_rows FROM events UNION ALL SELECT 'started', 0 UNION ALL SELECT 'terminated', 0")
def stream_events(spark, d):
    """What a streaming query over all events tells its listener: starts, rows taken in, ends."""
    stream = ingest.file_stream(spark, f"{d}/events.parquet")
    log = pipeline.watched(stream, lambda batch, number: batch.agg(F.count(F.lit(1))).collect())
    return log.where("event <> 'idle'").groupBy("event").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


@_register("""@all SELECT doc_id, round(1 - CASE WHEN js THEN 0.4 ELSE 0 END - CASE WHEN n_pages > 2 THEN 0.1 ELSE 0 END - CASE WHEN file THEN 0.3 ELSE 0 END, 6)::DOUBLE AS score,
 array_to_string(list_filter([CASE WHEN js THEN 'scripts:Error' END, CASE WHEN n_pages > 2 THEN 'many pages:Info' END, CASE WHEN file THEN 'files:Warning' END], lambda x: x IS NOT NULL), ',') AS problems FROM d""")
def registered_health(spark, d):
    """Three checkers in one aggregation over the objects of all documents."""
    own = Checkers()
    own.register(Checker("scripts", F.col("node_type") == "JavaScriptAction", 0.4, "Error"))
    own.register(Checker("many pages", F.col("node_type") == "Page", 0.1, "Info", most=2))
    own.register(Checker("files", F.col("node_type").isin("Filespec", "EmbeddedFile"), 0.3))
    found = own.check(pdf.objects(_rows(spark, d)).select("doc_id", "node_type"))
    return found.select("doc_id", "score", F.array_join(F.transform("problems", lambda p: F.concat(p["name"], F.lit(":"), p["severity"])), ",").alias("problems"))

"""Stages over streams, event logs and registered checkers."""

import pytest
from pyspark.sql import functions as F

from quire.functions.health import Checker, Checkers
from quire.sources import pdf
from quire.streaming import ingest, pipeline


def stream_of(spark, tmp_path, rows, schema, files=3, per_trigger=1):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return ingest.file_stream(spark, path, per_trigger)


def test_every_batch_goes_through_every_stage(spark, tmp_path):
    rows = [(k, pdf.render(k, f"alpha beta {k:05d}\nalpha é日本語 ab")) for k in range(1, 13)] + [(99, b"junk"), (100, None)]
    stream = stream_of(spark, tmp_path, rows, "doc_id long, content binary")
    out = pipeline.run_stages(stream, pipeline.standard_stages())
    assert set(out) == {"parsed", "objects", "issues", "index"}
    words = {}
    for r in out["index"].collect():
        words.setdefault(r.doc_id, set()).add(r.token)
    assert words == {k: {"alpha", "beta", f"{k:05d}", "é日本語"} for k in range(1, 13)}
    assert {r.doc_id for r in out["parsed"].where("kind = 'doc'").collect()} == {*range(1, 13), 99}
    assert {r.code for r in out["issues"].where("doc_id = 99").collect()} >= {"CATALOG_MISSING", "PAGES_TREE_MISSING"}


def test_stages_in_the_wrong_order(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [(1,)], "n long", 1)
    with pytest.raises(ValueError):
        pipeline.run_stages(stream, [pipeline.Stage("a", lambda df: df, "b"), pipeline.Stage("b", lambda df: df)])
    with pytest.raises(ValueError):
        pipeline.run_stages(stream, [pipeline.Stage("a", lambda df: df), pipeline.Stage("a", lambda df: df)])


def test_events_of_a_run_and_of_one_that_fails(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [(k,) for k in range(90)], "n long")
    seen = []
    log = pipeline.watched(stream, lambda batch, number: seen.append(batch.count())).collect()
    assert [r.event for r in log][0] == "started" and [r.event for r in log][-1] == "terminated" and log[-1].error is None
    assert sum(r.n_rows or 0 for r in log) == 90 == sum(seen) and len([r for r in log if r.event == "progress" and r.n_rows]) == 3


def test_the_log_keeps_the_last_events(spark):
    log = pipeline.EventLog(most=2)
    for k in range(5):
        log._add(query="q", event="progress", batch=k)
    assert [r.batch for r in log.table(spark).orderBy("place").collect()] == [3, 4]


def test_checkers_are_one_aggregation(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", None), (2, "b", 1), (3, None, None)], "doc_id long, kind string, n int")
    own = Checkers()
    assert {(r.doc_id, r.score, len(r.problems)) for r in own.check(rows).collect()} == {(1, 1.0, 0), (2, 1.0, 0), (3, 1.0, 0)}
    own.register(Checker("b", F.col("kind") == "b", 0.7))
    own.register(Checker("large", F.col("n") > 3, 0.6, "Error"))
    own.register(Checker("many", F.lit(True), 0.1, most=1))
    got = {r.doc_id: (r.score, [tuple(p) for p in r.problems]) for r in own.check(rows).collect()}
    assert got == {1: (0.0, [("b", "Warning", 1), ("large", "Error", 1), ("many", "Warning", 2)]), 2: (0.3, [("b", "Warning", 1)]), 3: (1.0, [])}
    plan = own.check(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    own.unregister("b")
    assert own.check(rows.limit(0)).count() == 0
    for wrong in (Checker("many", F.lit(True), 0.1), Checker("new", F.lit(True), 1.5)):
        with pytest.raises(ValueError):
            own.register(wrong)

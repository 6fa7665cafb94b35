"""What a stream of documents goes through, stage by stage, and what its queries report of themselves.

A pipeline is a list of named stages, each a function from one micro-batch's table to
another. Every batch is parsed once, each later stage reads what an earlier one stored,
and every stage's rows are a table of their own in the shared folder, one folder a batch:
a batch that comes again after a failure overwrites what it had written.
"""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import conformance
from ..sources import pdf
from ..sources.shared import ensure_checkpoint_dir


@dataclass(frozen=True)
class Stage:
    """``run`` makes a stage's rows of those of the stage named ``after`` (the batch itself without one)."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    after: str | None = None


def index_rows(objects: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, token): the different words of letters and digits, of ``least`` characters or more, that a document's pages show."""
    texts = pdf.page_texts(objects)
    words = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.length(w) >= least))
    return texts.select("doc_id", F.explode(words).alias("token")).distinct()


def standard_stages() -> list[Stage]:
    """Parsing of (doc_id, content), its objects, the base profile's rules and an index of words."""
    return [
        Stage("parsed", pdf.parse),
        Stage("objects", pdf.objects, "parsed"),
        Stage("issues", lambda rows: conformance.issues(rows, "PDF-2.0"), "parsed"),
        Stage("index", index_rows, "objects"),
    ]


def run_stages(stream: DataFrame, stages: list[Stage]) -> dict[str, DataFrame]:
    """All that is there in ``stream`` through ``stages``; each stage's table by its name.

    Stages must come after those they read. A stage that fails stops the stream; what
    batches before it have written stays.
    """
    known: set[str | None] = {None}
    for stage in stages:
        if stage.after not in known or stage.name in known:
            raise ValueError(f"stage {stage.name} comes before what it reads, or twice")
        known.add(stage.name)
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"
    schemas: dict = {}

    def step(batch: DataFrame, epoch: int) -> None:
        tables: dict = {None: batch}
        for stage in stages:
            out = stage.run(tables[stage.after])
            out.write.mode("overwrite").parquet(f"{base}/{stage.name}/epoch={epoch}")
            schemas[stage.name] = out.schema
            tables[stage.name] = spark.read.schema(out.schema).parquet(f"{base}/{stage.name}/epoch={epoch}")

    stream.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return {name: spark.read.schema(schema).option("basePath", f"{base}/{name}").parquet(f"{base}/{name}").select(*schema.names) for name, schema in schemas.items()}


EVENTS = "query string, event string, batch long, n_rows long, rate double, error string"


class EventLog(StreamingQueryListener):
    """A listener that keeps the last ``most`` events of streaming queries, and gives them as a table."""

    def __init__(self, most: int = 10_000):
        self._events: deque = deque(maxlen=most)
        self._lock = threading.Lock()
        self._ended = threading.Condition(self._lock)
        self._done: set[str] = set()

    def _add(self, **values) -> None:
        with self._lock:
            self._events.append(Row(**{"query": None, "event": None, "batch": None, "n_rows": None, "rate": None, "error": None, **values}))

    def onQueryStarted(self, event) -> None:  # noqa: N802  (names of the listener's interface)
        self._add(query=str(event.id), event="started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._add(query=str(p.id), event="progress", batch=p.batchId, n_rows=p.numInputRows, rate=float(p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._add(query=str(event.id), event="idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add(query=str(event.id), event="terminated", error=event.exception)
        with self._lock:
            self._done.add(str(event.id))
            self._ended.notify_all()

    def table(self, spark) -> DataFrame:
        """The events kept, in order of ``place``."""
        with self._lock:
            kept = [(k, *(e[name] for name in ("query", "event", "batch", "n_rows", "rate", "error"))) for k, e in enumerate(self._events)]
        return spark.createDataFrame(kept, f"place int, {EVENTS}")


def watched(stream: DataFrame, each: Callable[[DataFrame, int], None], wait: float = 30.0) -> DataFrame:
    """The events of one run of all that is there in ``stream`` through ``each`` (batch, number)."""
    spark = stream.sparkSession
    log = EventLog()
    spark.streams.addListener(log)
    try:
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
        query = stream.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(each).start()
        query.awaitTermination()
        with log._ended:  # events come on a thread of their own
            log._ended.wait_for(lambda: str(query.id) in log._done, wait)
    finally:
        spark.streams.removeListener(log)
    return log.table(spark).where(F.col("query") == str(query.id))

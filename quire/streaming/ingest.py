"""Incremental ingest with Structured Streaming: counts, windows, late references, chunk checks.

Every query runs over a file stream; what arrives in a trigger is one micro-batch,
state is keyed and lives with the executors, and results go to a table in the
shared folder. ``drain`` processes all that is there and returns that table.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import ensure_checkpoint_dir


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files in the folder ``path``, or of the one file of that name, typed as the table there."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if all(f.endswith(f"/{name}") for f in table.inputFiles()[:1]):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through ``stream``, as a table: appended rows, or the last complete result."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that is run again after a failure overwrites what it had written
        batch.write.mode("overwrite").parquet(f"{base}/table/epoch={epoch if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table").select(*stream.columns)


def consume(stream: DataFrame, each: Callable[[DataFrame, int], bool]) -> int:
    """Gives the micro-batches of all that is there to ``each`` until it returns False; the number of batches it was given.

    A batch can come again after a failure, under its old number.
    """
    base = f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    given, ended = set(), threading.Event()

    def step(batch: DataFrame, epoch: int) -> None:
        if not ended.is_set():
            given.add(epoch)
            if each(batch, epoch) is False:
                ended.set()

    query = stream.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(step).start()
    while not query.awaitTermination(1):
        if ended.is_set():
            query.stop()
    return len(given)


def observed(df: DataFrame, name: str, kind: str = "node_type") -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its rows and of its kinds (about), filled when an action has run through it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n"), F.approx_count_distinct(kind).alias("kinds")), seen


def type_counts(events: DataFrame, kind: str = "event_type") -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, total) by tumbling window; rows later than ``late`` are dropped once their window is closed."""
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), kind)
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


STATE = "seen boolean, pending array<long>"


def _resolve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Edges of one target: references wait for it, and go out at once when it has been seen."""
    seen, pending = state.get if state.exists else (False, [])
    pending = list(pending)
    for rows in batches:
        seen = seen or bool(rows["is_target"].any())
        pending += rows.loc[~rows["is_target"], "src"].tolist()
    if seen and pending:
        yield pd.DataFrame({"dst": [key[0]] * len(pending), "src": pending})
        pending = []
    state.update((seen, pending))


def resolved_references(arrivals: DataFrame) -> DataFrame:
    """(dst, src) edges of a stream of (dst, src, is_target): references and targets in any order."""
    return arrivals.groupBy("dst").applyInPandasWithState(_resolve, "dst long, src long", STATE, "append", GroupStateTimeout.NoTimeout)


def checked_chunks(chunks: DataFrame) -> DataFrame:
    """Adds ``crc`` of each chunk's bytes and whether it equals the one that came with it."""
    crc = F.crc32(F.encode("data", "UTF-8"))
    return chunks.withColumn("actual", crc).withColumn("intact", F.col("crc") == F.col("actual"))

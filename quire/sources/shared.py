"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of this machine is set only where none is and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: worked out once, lineage cut, read again if an executor is lost."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Stored tables of one schema as a single scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._stored_at for t in tables))


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def row_batches(found: Iterator[tuple[object, list[tuple], int]], names: list[str], types: list[pa.DataType], rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of (key, rows, bytes they came from): many keys in one batch, up to about ``rows`` rows or ``size`` bytes."""

    def batch() -> pa.RecordBatch:
        columns = zip(*((key, *row) for key, out in held for row in out))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    held, n, weight = [], 0, 0
    for key, out, more in found:
        if out:
            held.append((key, out))
            n, weight = n + len(out), weight + more
        if held and (n >= rows or weight >= size):
            yield batch()
            held, n, weight = [], 0, 0
    if held:
        yield batch()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as a shuffle has: for small tables whose rows take long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

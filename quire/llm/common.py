"""What the operators of this subpackage share: text buffers and shared tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset (single-process sessions, as in tests) a folder of this
    machine is made and set; on a cluster that would lose data, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, losses are re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for ``forget``
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once all that was made from them is stored itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and its n + 1 offsets. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges (i, j) of at most ``most`` bytes each, or of one row where a row is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def random_words(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every process."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(links: DataFrame, tag: str = "labels") -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): label is the smallest id it is connected to.

    Labels start as the smallest neighbour; each round takes the smallest label
    around an id and then that label's own label (pointer jumping), so the rounds
    needed grow with the logarithm of the longest chain. Every round is one stored
    table; the driver sees only a count of changes.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    both = stored(both.distinct(), tag)
    last = labels = stored(both.groupBy("id").agg(F.least("id", F.min("other")).alias("label")), tag)
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = stored(step.join(jump, "label", "left").select("id", "old", F.least("label", "further").alias("label")), tag)
        changed = step.where("label <> old").limit(1).count()
        forget(last)
        last, labels = step, step.select("id", "label")
        if not changed:
            forget(both)
            return labels


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], parts: int = 4096) -> DataFrame:
    """Inner join of stored ``rows`` with stored ``keys`` that no common key slows down.

    ``keys`` has one row a key and ``times``, how many of ``rows`` have it. Keys with
    more than one in ``parts`` of the rows, ``parts`` at most, are broadcast.
    """
    least = max(64, rows.count() // parts)
    common, rest = keys.where(F.col("times") > least), keys.where(F.col("times") <= least)
    few = rows.join(F.broadcast(common.select(on)), on, "left_anti").join(rest, on)
    return rows.join(F.broadcast(common), on).unionByName(few)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once.

    The optimizer merges projections, so a column used inside a lambda would be
    worked out anew for every element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))

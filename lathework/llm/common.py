"""Helpers shared by the corpus operators: tables, durable cuts, Arrow columns."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``; only a session on one machine
    (tests) that has none gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='lathework-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its cluster owns the folder
            return


def discard(df: DataFrame) -> None:
    """Remove a table that ``written`` made and nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        _delete(df.sparkSession, path)


atexit.register(_forget)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lathework-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Arrow batches of what this package runs itself: the JVM and Python each hold one or two for every task.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


#: Tables whose rows hold megabytes: few rows in a page and in what a scan takes at once.
_WIDE = {"spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
_WIDE_PAGES = {"parquet.page.row.count.limit": "4", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.enable.dictionary": "false"}


@contextlib.contextmanager
def small_batches(spark: SparkSession, wide: bool = False):
    """Small Arrow batches while an action of this package runs; the session's own settings come back after it.

    ``wide``: the action reads a table whose rows hold megabytes.
    """
    own = _BATCHES | _WIDE if wide else _BATCHES
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, wide: str = "", few: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    Spark's committer writes it, so a lost executor costs only its tasks.
    ``wide``: rows of megabytes are "read" by it or "written".  ``few``: many
    tasks give a few rows each, which are brought together first; on a local
    file system without Hadoop's native library the executor launches three
    processes for every file.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = (df.hint("rebalance") if few else df).write.mode("overwrite").option("compression", "zstd")
    if wide == "written":
        writer = writer.options(**_WIDE_PAGES)
    with small_batches(spark, wide == "read"):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out._written_at = path
    return out


#: A key with more than one in HOT_SHARE of all rows (and HOT_ROWS rows) is hot.
HOT_SHARE, HOT_ROWS = 1024, 1000


def skewed_join(rows: DataFrame, small: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join on ``key`` whatever a key holds.

    ``small`` is a written table with one row for each key and, in ``count``,
    how many of ``rows`` have it.  Fewer than ``HOT_SHARE`` keys can hold more
    than one in ``HOT_SHARE`` of the rows each: these few are broadcast and
    meet their rows where they lie; the other keys are joined by key.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot = small.where(F.col(count) > least)
    if hot.isEmpty():
        return rows.join(small.drop(count), key)
    few = rows.join(F.broadcast(hot.drop(count)), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col(count) <= least).drop(count), key)
    return few.unionByName(rest)


def slices(batches, rows: int = 256):
    """Arrow batches in slices of few rows: only these become Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        pa.default_memory_pool().release_unused()
    tidy()


def tidy() -> None:
    """Give freed memory back: Python workers live on after a task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(counts: DataFrame, key: str, value: str, block: int = 4096) -> DataFrame:
    """``counts`` with column ``before``: the sum of ``value`` over smaller ``key``.

    ``key`` is a dense non-negative integer with one row each.  Blocks of
    ``block`` keys are summed first, so that no task sorts more than ``block``
    rows or one row for each block.
    """
    from pyspark.sql import Window

    kept = counts.withColumn("_block", F.floor(F.col(key) / block))
    sums = kept.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        kept.join(sums.select("_block", before.alias("_first")), "_block")
        .withColumn("before", (F.col("_first") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long"))
        .drop("_block", "_first")
    )

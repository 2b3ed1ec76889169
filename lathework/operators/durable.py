"""Cuts of a lineage that survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that the cluster names in ``spark.checkpoint.dir``.

    A session on one machine without such a folder (tests) gets a temporary one;
    a cluster without one is refused.
    """
    durable_dir(df.sparkSession)
    return df.checkpoint()


def durable_dir(spark) -> None:
    """Make sure that the session has a checkpoint folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='lathework-')}")


def shared_path(spark, name: str) -> str:
    """A new path in the folder that driver and executors share; removed when the driver ends."""
    durable_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: its cluster owns the folder
        return

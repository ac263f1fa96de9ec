"""Intermediate tables in shared storage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []

#: A side is broadcast only when its optimised plan is estimated at or below this many bytes.
BROADCAST_BYTES = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="arbolith-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed like the tables of :func:`materialize`."""
    path = f"{shared_dir(spark).rstrip('/')}/arbolith-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    It cuts the lineage, survives the loss of executors, and is computed once
    however often the result is read. Files are removed when the driver exits,
    or earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where :func:`release` is to stop: what is written from now on goes."""
    return len(_written)


def release(since: int = 0) -> None:
    """Remove the tables written by :func:`materialize` since the ``since`` of :func:`mark`; results reading them must be done.

    A long session calls it after each query it has used up.
    """
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            continue  # the session is gone, and its folder with it


atexit.register(release)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; for scans it follows the files' sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is within ``limit``, else unchanged.

    Unchanged means a shuffled join, so a side that grew past the bound stays correct.
    """
    return F.broadcast(df) if plan_bytes(df) <= limit else df

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITERS: dict[str, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and driver and executors are one process."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="apexlap-"))


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes are dropped when these end; the session's own setting comes back after the last of them."""
    key = spark.conf.get("spark.app.id") + str(id(spark._jsparkSession))
    with _LOCK:
        held = _WRITERS.setdefault(key, [0, spark.conf.get(_CLEAN, "false")])
        held[0] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(_CLEAN, _WRITERS.pop(key)[1])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet and read back: cut lineage that outlives executors.

    `discard` removes the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` returned; no later job may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

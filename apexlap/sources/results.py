"""Results that are computed once for each session and method.

A folder holds `rows`, partitioned by session and method, and `done`, which
lists the pairs that have been computed, those without any row included. Only
pairs that aren't listed are computed; their partitions are overwritten as a
whole and listed last, so a run that broke off is made good by the next one and
running again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.roads import missing_results
from .staging import written

KEY = "session_id string, method string"


def stored_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The (session_id, method) that have been computed; none where there is no folder yet."""
    spark.createDataFrame([], KEY).write.mode("append").parquet(f"{path}/done")
    return spark.read.schema(KEY).parquet(f"{path}/done").distinct()


def update_results(path: str, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (session_id, method) that this call computed.

    compute: from such pairs to rows with session_id, method and more columns;
    it isn't called if nothing is missing. NULL pairs are left out, repeated ones
    are one.
    """
    spark = wanted.sparkSession
    wanted = wanted.select(F.col("session_id").cast("string").alias("session_id"), F.col("method").cast("string").alias("method"))
    missing = written(missing_results(wanted.dropna().distinct(), stored_pairs(spark, path)), "missing")
    if not missing.isEmpty():
        rows = compute(missing)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "method").parquet(f"{path}/rows")
        missing.write.mode("append").parquet(f"{path}/done")
    return missing


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All stored rows; schema: their columns, session_id and method last. A filter on these reads their folders alone."""
    return spark.read.schema(schema).parquet(f"{path}/rows")

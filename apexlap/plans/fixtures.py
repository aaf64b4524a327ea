"""Tracks, log lines and roads derived from the `events` and `part` tables.

The tables hold no tracks. Every event becomes a sample of one of SESSIONS
sessions that drive round a closed path of lattice points; only literals and
basic arithmetic are used, so that SQL engines derive equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSIONS = 16
#: The path of the fixtures.
PATH = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (6, 1), (6, 2), (6, 3), (6, 4), (6, 5), (6, 6), (6, 7), (6, 8), (5, 8), (4, 8), (3, 8), (2, 8), (2, 7), (2, 6), (2, 5), (1, 5), (0, 5), (-1, 5), (-2, 5), (-2, 6), (-2, 7), (-2, 8), (-3, 8), (-4, 8), (-5, 8), (-5, 7), (-5, 6), (-5, 5), (-5, 4), (-5, 3), (-5, 2), (-5, 1), (-5, 0), (-4, 0), (-3, 0), (-2, 0), (-1, 0)]
HEADERS = {"Fix": ["LatitudeDegrees", "LongitudeDegrees", "SpeedMps", "UnixTimeMillis", "Pad"], "Raw": ["utcTimeMillis", "Pad"], "Accel": ["AccelXMps2", "AccelYMps2", "AccelZMps2", "Pad"], "UncalAccel": ["UncalAccelXMps2", "UncalAccelYMps2", "UncalAccelZMps2", "Pad"], "Gyro": ["GyroXRadPerSec", "GyroYRadPerSec", "GyroZRadPerSec", "Pad"]}


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value", (F.col("user_id") % SESSIONS).alias("session_id"))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")).cast("long") - 1)


def _milliseconds():
    st = F.col("rn") - F.when(F.col("rn") % 50 == 49, 1).otherwise(0)
    return F.lit(1700000000000) + st * 1000 + 13 * (st % 7)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series: session_id, sample_idx, timestamp_ms, lat, lon, speed_mps."""
    at = (F.col("rn") % len(PATH)).cast("int")
    px, py = (F.get(F.array(*(F.lit(p[i]) for p in PATH)), at) for i in (0, 1))
    noise = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(7)) - 3
    seen = F.col("rn") % 37 != 36
    return _numbered(spark, sf_dir).select(F.col("session_id").cast("string").alias("session_id"), F.col("rn").cast("long").alias("sample_idx"), _milliseconds().cast("double").alias("timestamp_ms"), F.when(seen, F.lit(40.0) + py * F.lit(5e-5) + noise * F.lit(1e-7)).alias("lat"), F.when(seen, F.lit(-80.0) + px * F.lit(5e-5)).alias("lon"), (F.col("value") / 7.0).alias("speed_mps"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, line_no, line: the five event types as five record types."""
    e, v = _numbered(spark, sf_dir), F.round(F.col("value") * 100).cast("long").cast("string")
    ms = _milliseconds().cast("long").cast("string")
    fix = F.concat_ws(",", F.lit("Fix"), F.concat(F.lit("40."), v), F.concat(F.lit("-80."), v), v, F.when(F.col("event_id") % 11 == 0, "").otherwise(ms), F.lit("0"))
    other = lambda n: F.concat_ws(",", F.lit(n), v, F.lit("0.5"), F.lit("1"), F.lit("0"))
    kind = F.col("event_type")
    line = F.when(kind == "signup", fix).when(kind == "click", other("Accel")).when(kind == "error", other("UncalAccel")).when(kind == "view", other("Gyro")).otherwise(F.concat_ws(",", F.lit("Raw"), ms, F.lit("0")))
    return e.select(F.col("session_id").cast("string").alias("session_id"), F.col("rn").cast("long").alias("line_no"), line.alias("line"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, highway, coords: the path's edges, and a far lattice edge for each part."""
    n = len(PATH)
    rows = [(i, "primary", [(-80 + x * 5e-5, 40 + y * 5e-5) for x, y in (PATH[i], PATH[(i + 1) % n])]) for i in range(n)]
    path = spark.createDataFrame(rows, "edge_id long, highway string, coords array<struct<lon:double,lat:double>>")
    k = F.col("p_partkey")
    lon, lat = F.lit(-79.99) + (k % 100) * F.lit(1e-4), F.lit(40.01) + (k % 97) * F.lit(1e-4)
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    far = spark.read.parquet(f"{sf_dir}/part.parquet").select((k + 1000).cast("long").alias("edge_id"), F.when(F.col("p_size") % 5 == 0, "service").otherwise("residential").alias("highway"), F.array(point(lon, lat), point(lon + F.lit(1e-4), lat)).alias("coords"))
    return path.unionByName(far)

"""Motion metrics of sessions and the telemetry projection.

A session's samples have one sample_idx each, without gaps (`chunks`); with
repeated ones the order of those is undefined. NULL positions give NULL local positions and no heading
change, NULL speeds count as 0, a step of no time has no dt. A session of one
sample has zero distance and accelerations. An empty table gives an empty
result. Extra columns pass through; those named like a metric are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import latlon_to_xy
from ..functions.numbers import finite, preserved, rounded
from ..functions.smoothing import reach, smoothed
from .chunks import CHUNK, KEY, add_running_sums, chunk_window, in_chunks, own_rows, session_facts

#: Columns of a series that may be absent from a source.
OPTIONAL = {"alt": "double", "speed_mps": "double", "pos_accuracy_m": "double", "imu_accel_x": "double", "imu_accel_y": "double", "imu_accel_z": "double", "imu_gyro_z": "double", "has_accel": "boolean"}
MPH, MILES = 2.23694, 0.000621371


def with_smoothed(df: DataFrame, method: str, window: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df (in chunks, with first_lat, last_lat, first_lon, last_lon, first_idx, last_idx) with smoothed lat and lon under their own or other names."""
    at, size = F.col("sample_idx") - F.col("first_idx") + 1, F.col("last_idx") - F.col("first_idx") + 1
    values = {n: smoothed(F.col(c), chunk_window(), None, method, window, (F.col(f"first_{c}"), F.col(f"last_{c}"), at, size)) for n, c in ((lat, "lat"), (lon, "lon"))}
    return df.withColumns(values)


def positions_in_chunks(series: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """series in chunks with what the smoothing and the time since start ask of the session."""
    ends = {f"{e}_{c}": f(c, "sample_idx") for c in ("lat", "lon") for e, f in (("first", F.min_by), ("last", F.max_by))}
    first_ms = {"first_ms": F.min_by("timestamp_ms", "sample_idx")} if "timestamp_ms" in series.columns else {}
    facts = session_facts(series, size, ends | first_ms | {"first_idx": F.min("sample_idx"), "last_idx": F.max("sample_idx")})
    return in_chunks(series, size, before, after).join(facts, KEY)


FACTS = ["first_lat", "last_lat", "first_lon", "last_lon", "first_ms", "first_idx", "last_idx"]


def compute_derived_metrics(series: DataFrame, smooth_position: bool = True, smooth_method: str = "ma", smooth_window: int = 5, chunk: int = CHUNK) -> DataFrame:
    """Elapsed time, local position, speed, distance, heading and accelerations.

    All windows share one partitioning and one order, that of chunks of a
    session, so the samples are dealt out and sorted once and a long session is
    the work of many tasks. Distance and heading run on over chunks by their
    totals; the heading's rate comes from the turns on both sides.
    """
    df = series.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in series.columns})
    before, after = reach(smooth_method, smooth_window) if smooth_position else (0, 0)
    w = chunk_window()
    df = positions_in_chunks(df, chunk, before + 2, after + 1)
    df = df.withColumn("elapsed_s", (F.col("timestamp_ms") - F.col("first_ms")) / 1000.0)
    df = df.withColumn("dt_s", F.nullif(F.col("elapsed_s") - F.lag("elapsed_s").over(w), F.lit(0.0)))
    if smooth_position:
        df = with_smoothed(df, smooth_method, smooth_window)
    seen = lambda c: F.min_by(F.col(c), F.when(F.col("own__") & F.col(c).isNotNull(), F.col("sample_idx")))
    df = df.join(session_facts(df.where("own__"), chunk, {"lat0": seen("lat"), "lon0": seen("lon")}), KEY)
    x, y = latlon_to_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    df = df.withColumns({"x_m": x, "y_m": y, "speed_mps": F.coalesce("speed_mps", F.lit(0.0))})
    df = df.withColumns({"speed_mph": F.col("speed_mps") * MPH, "segment_distance_m": F.col("speed_mps") * F.coalesce("dt_s", F.lit(0.0)), "dx": F.col("x_m") - F.lag("x_m").over(w), "dy": F.col("y_m") - F.lag("y_m").over(w)})
    df = df.withColumns({"speed_course_mps": F.try_divide(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.col("dt_s")), "course": F.atan2(F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0)))})
    turn = F.col("course") - F.lag("course").over(w)
    wrapped = F.pmod(turn + math.pi, F.lit(2 * math.pi)) - math.pi
    wrapped = F.when((wrapped == -math.pi) & (turn > 0), F.lit(math.pi)).otherwise(wrapped)
    jump = F.when(F.abs(turn) < math.pi, 0.0).otherwise(F.coalesce(wrapped - turn, F.lit(0.0)))
    df = df.withColumns({"turn": turn, "jump": jump})
    # f - f0 and f2 - f of the unwrapped heading, without its total
    back, ahead = F.col("turn") + F.col("jump"), F.lead(F.col("turn") + F.col("jump")).over(w)
    h1, h2 = F.col("elapsed_s") - F.lag("elapsed_s").over(w), F.lead("elapsed_s").over(w) - F.col("elapsed_s")
    inner = F.try_divide(h2, h1 * (h1 + h2)) * back + F.try_divide(h1, h2 * (h1 + h2)) * ahead
    rate = F.when(back.isNull(), F.try_divide(ahead, h2)).when(ahead.isNull(), F.try_divide(back, h1)).otherwise(inner)
    long_own = F.try_divide(F.col("speed_mps") - F.lag("speed_mps").over(w), F.col("dt_s"))
    has = F.coalesce("has_accel", F.lit(False))
    df = df.withColumns({"long_accel_mps2": F.coalesce(finite(F.when(has, F.col("imu_accel_y")).otherwise(long_own)), F.lit(0.0)), "lat_accel_mps2": F.coalesce(finite(F.when(has, F.col("imu_accel_x")).otherwise(F.col("speed_mps") * rate)), F.lit(0.0))})
    df = add_running_sums(df, {"distance_along_m": F.col("segment_distance_m"), "jumps": F.col("jump")})
    df = df.withColumns({"heading_deg": F.degrees(F.col("course") + F.col("jumps")), "distance_along_mi": F.col("distance_along_m") * MILES})
    return own_rows(df).drop("dx", "dy", "course", "turn", "jump", "jumps", "lat0", "lon0", *FACTS)


def build_telemetry_records(metrics: DataFrame) -> DataFrame:
    """The sixteen telemetry fields; positions and distance keep their digits."""
    digits = {"elapsed_s": 3, "alt": 2, "speed_mps": 3, "speed_mph": 3, "long_accel_mps2": 3, "lat_accel_mps2": 3, "heading_deg": 2, "imu_accel_x": 3, "imu_accel_y": 3, "imu_accel_z": 3, "imu_gyro_z": 3, "pos_accuracy_m": 3}
    stamp = F.date_format(F.timestamp_millis(F.round("timestamp_ms").cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return metrics.select("session_id", "sample_idx", stamp.alias("timestamp"), preserved(F.col("lat").cast("double")).alias("lat"), preserved(F.col("lon").cast("double")).alias("lon"), preserved(F.col("distance_along_m")).alias("distance_m"), *(rounded(F.col(c), d).alias(c) for c, d in digits.items()))

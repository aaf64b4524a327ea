"""Corners from the curvature of the path.

Samples without a position have curvature 0 and no place in a corner's
geometry; a NULL speed or acceleration counts as 0. The slowest sample is the
apex, the first of equal ones. Laps without corners give no row, empty tables
empty results. Columns of telemetry that are named like a result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from .chunks import CHUNK, in_chunks, own_rows
from .laps import lap_samples

G = 9.80665


def lap_curvature(telemetry: DataFrame, laps: DataFrame, spread: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Lap samples with k: signed curvature in 1/degree of the samples `spread` apart, 0 near a lap's ends."""
    lap = Window.partitionBy("session_id", "start_sample_idx", "chunk__").orderBy("sample_idx")
    s = in_chunks(lap_samples(telemetry, laps), chunk, spread, spread)
    ux, uy = F.col("lon") - F.lag("lon", spread).over(lap), F.col("lat") - F.lag("lat", spread).over(lap)
    vx, vy = F.lead("lon", spread).over(lap) - F.col("lon"), F.lead("lat", spread).over(lap) - F.col("lat")
    norm = lambda x, y: F.sqrt(x * x + y * y)
    k = F.try_divide(2 * (ux * vy - uy * vx), norm(ux, uy) * norm(vx, vy) * norm(ux + vx, uy + vy))
    inside = (F.col("pos") >= spread) & (F.col("sample_idx") < F.col("end_sample_idx") - spread)
    return own_rows(s.withColumn("k", F.when(inside, F.coalesce(k, F.lit(0.0))).otherwise(0.0)))


def corner_ranges(curvature: DataFrame, threshold: float = 6e3, least: float = 3e3, first: int = 0) -> DataFrame:
    """session_id, lap_number, start_sample_idx, corner_id, a, b: first and last sample of each corner.

    A corner begins a sample before its run, but not before position `first` of
    the lap, where curvature is first known.
    Runs of one sign above `least` are corners if a sample reaches `threshold`.
    A run that touches the one before starts a sample late in a scan, so one that
    reaches it with its first sample alone is a corner only if the run before
    isn't; streaks of such runs alternate.
    """
    lap = Window.partitionBy("session_id", "start_sample_idx").orderBy("pos")
    key = ["session_id", "lap_number", "start_sample_idx"]
    c = curvature.select(*key, "end_sample_idx", "pos", "k", F.when(F.abs("k") > least, F.signum("k")).otherwise(0.0).alias("state"))
    c = c.withColumn("run", F.sum((F.col("state") != F.coalesce(F.lag("state").over(lap), F.lit(9.0))).cast("int")).over(lap))
    runs = c.where("state != 0").groupBy(*key, "end_sample_idx", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.max(F.abs("k") >= threshold).alias("all"), (F.sum((F.abs("k") >= threshold).cast("int")) - F.max_by((F.abs("k") >= threshold).cast("int"), -F.col("pos")) > 0).alias("rest"))
    w = Window.partitionBy("session_id", "start_sample_idx").orderBy("a")
    touching = F.coalesce(F.lag("b").over(w) + 1 == F.col("a"), F.lit(False))
    r = runs.withColumn("touching", touching).withColumn("kind", F.when(F.col("rest"), "yes").when(~F.col("all"), "no").otherwise("maybe"))
    r = r.withColumn("streak", F.sum(F.when((F.col("kind") == "maybe") & F.col("touching"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy("session_id", "start_sample_idx", "streak").orderBy("a")
    r = r.withColumns({"p": F.row_number().over(inside), "head": F.first("kind").over(inside)})
    # the head is definite, or a run that touches nothing before it and so is a corner
    flip = (F.col("p") - 1) % 2 == 1
    base = F.col("head") != "no"
    r = r.withColumn("corner", F.when(F.col("kind") == "yes", True).when(F.col("kind") == "no", False).otherwise(F.when(flip, ~base).otherwise(base)))
    n = F.col("end_sample_idx") - F.col("start_sample_idx")
    r = r.where("corner").withColumn("corner_id", F.row_number().over(w))
    return r.select(*key, "corner_id", (F.col("start_sample_idx") + F.greatest(F.col("a") - 1, F.lit(first))).alias("a"), (F.col("start_sample_idx") + F.least(F.col("b") + 1, n)).alias("b"))


def detect_corners(telemetry: DataFrame, laps: DataFrame, threshold_curvature: float = 6e3, min_curvature: float = 3e3, spread: int = 2) -> DataFrame:
    """Corner records: speeds, lateral g, duration, geometry and the slowest point of each corner."""
    ranges = corner_ranges(lap_curvature(telemetry, laps, spread), threshold_curvature, min_curvature, spread)
    t = telemetry.select("session_id", F.col("sample_idx").cast("long").alias("sample_idx"), "lat", "lon", "speed_mph", "lat_accel_mps2", "elapsed_s")
    rows = ranges.withColumn("sample_idx", F.explode(F.sequence("a", "b"))).join(t, ["session_id", "sample_idx"])
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("sample_idx", F.array("lon", "lat").alias("p")))
    speed, g = F.coalesce("speed_mph", F.lit(0.0)), F.abs(F.coalesce("lat_accel_mps2", F.lit(0.0))) / G
    c = rows.groupBy("session_id", "lap_number", "start_sample_idx", "corner_id", "a", "b").agg(
        half_up(F.min_by(speed, "sample_idx"), 1).alias("entry_speed_mph"), half_up(F.max_by(speed, "sample_idx"), 1).alias("exit_speed_mph"),
        half_up(F.min(speed), 1).alias("min_speed_mph"), half_up(F.max(g), 3).alias("max_lat_g"),
        half_up(F.max_by("elapsed_s", "sample_idx") - F.min_by("elapsed_s", "sample_idx"), 3).alias("duration_s"),
        F.transform(F.sort_array(F.collect_list(point)), lambda x: x["p"]).alias("geometry"),
        F.min_by(F.struct("lat", "lon"), F.struct(speed, "sample_idx")).alias("apex"))
    return c.drop("start_sample_idx")

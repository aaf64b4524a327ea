"""Time against the reference lap at equal distance.

Samples without a lap are left out; sessions with fewer than two timed full laps
give nothing, and laps without a time are not compared. Points of equal distance keep the order of samples, of equal lap
times the first lap is the reference, repeated questions are answered once.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..sources.staging import written
from .asof import as_of, with_previous
from .laps import lap_samples


def reference_laps(laps: DataFrame) -> DataFrame:
    """The fastest timed full lap of each session with two of them at least; the first wins ties."""
    by = Window.partitionBy("session_id")
    timed = laps.where("not is_partial and lap_time_s > 0").withColumn("n", F.count(F.lit(1)).over(by))
    timed = timed.withColumn("r", F.row_number().over(by.orderBy("lap_time_s", "lap_number"))).where("n > 1 and r = 1")
    return timed.select("session_id", F.col("lap_number").alias("reference_lap"), F.col("lap_time_s").alias("reference_time_s"))


def _samples(annotated: DataFrame, laps: DataFrame) -> DataFrame:
    s = lap_samples(annotated, laps.where("not is_partial"))
    return s.where("lap_distance_m is not null and lap_elapsed_s is not null").select("session_id", "lap_number", "sample_idx", "pos", F.col("lap_distance_m").alias("d"), F.col("lap_elapsed_s").alias("t"), (F.col("sample_idx") == F.col("end_sample_idx")).alias("shared_end"))


def lap_delta_traces(annotated: DataFrame, laps: DataFrame, drop_shared_end: bool = False) -> DataFrame:
    """session_id, lap_number, reference_lap, sample_idx, distance_m, time_delta_s.

    Each sample of another lap takes the last point of the reference curve at or
    before its distance by an as-of join in bins of distance, so the work is
    linear in samples. Both ends are clamped.
    """
    timed = laps.where("not is_partial and lap_time_s > 0")
    s = _samples(annotated, timed)
    s = s.where("not shared_end") if drop_shared_end else s
    ref = written(s.join(reference_laps(laps), "session_id"), "compared")
    curve = ref.where("lap_number = reference_lap").select("session_id", "d", "t", "sample_idx")
    curve = with_previous(curve, ["session_id"], "d", "sample_idx", {"d_before": "d"}).where("d_before is null or d - d_before > 1e-6")
    curve = curve.select("session_id", "d", "t", "sample_idx")
    # each point of the curve with the next one
    back = curve.withColumns({"down": -F.col("d"), "turn": -F.col("sample_idx")})
    curve = with_previous(back, ["session_id"], "down", "turn", {"d2": "d", "t2": "t"}).drop("down", "turn")
    curve = written(curve, "curve")
    first = curve.groupBy("session_id").agg(F.min_by(F.struct("d", "t", "d2", "t2"), F.struct("d", "sample_idx")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    others = ref.where("lap_number != reference_lap").select("session_id", "lap_number", "reference_lap", "sample_idx", "d", "t").join(first, "session_id")
    found = as_of(others, curve, ["session_id"], "d", "d", "sample_idx", ["d", "t", "d2", "t2"])
    before = F.coalesce("found", "first")
    inside = before["t"] + (before["t2"] - before["t"]) * F.try_divide(F.col("d") - before["d"], before["d2"] - before["d"])
    own = F.when(F.col("found").isNull() | before["d2"].isNull(), before["t"]).otherwise(inside)
    return found.select("session_id", "lap_number", F.col("reference_lap").cast("int").alias("reference_lap"), F.col("sample_idx").cast("long").alias("sample_idx"), half_up(F.col("d"), 2).alias("distance_m"), half_up(F.col("t") - own, 3).alias("time_delta_s"))


def nested_traces(traces: DataFrame, laps: DataFrame) -> DataFrame:
    """One row for each compared lap with its trace as an array."""
    times = laps.where("not is_partial").select("session_id", "lap_number", "lap_time_s")
    t = traces.groupBy("session_id", "lap_number", "reference_lap").agg(F.expr("transform(sort_array(collect_list(struct(sample_idx, distance_m, time_delta_s))), x -> struct(x.distance_m, x.time_delta_s))").alias("trace"))
    ref = times.select("session_id", F.col("lap_number").alias("reference_lap"), F.col("lap_time_s").alias("reference_time_s"))
    return t.join(times, ["session_id", "lap_number"]).join(ref, ["session_id", "reference_lap"])


def delta_at_distance(annotated: DataFrame, laps: DataFrame, asked: DataFrame, width_m: float = 100.0) -> DataFrame:
    """asked (session_id, lap1, lap2, distance_m) with delta_s: lap1's time less lap2's there.

    A lap's samples lie in order of distance, equal ones in order of time. The
    first step that ends at or behind the distance tells the time, also for a
    distance before the lap's first sample; beyond the last sample its time
    counts. NULL if a lap isn't a full one or has fewer than two samples, or if
    the distance is NULL or NaN. Questions and steps meet in bins of width_m.
    """
    key = ["session_id", "lap_number"]
    s = written(with_previous(_samples(annotated, laps).select(*key, "pos", "d", "t"), key, "d", "pos", {"d0": "d", "t0": "t"}, width_m), "steps")
    steps = s.where("d0 is not null")
    ends = steps.groupBy(*key).agg(F.max_by("t", F.struct("d", "pos")).alias("end_t"))
    asked = asked.select("session_id", "lap1", "lap2", F.col("distance_m").cast("double").alias("distance_m")).dropDuplicates()
    sides = asked.select("session_id", F.explode(F.array("lap1", "lap2")).alias("lap_number"), F.col("distance_m").alias("x")).where("x is not null and not isnan(x)").distinct()
    found = as_of(sides, steps, key, "x", "d", "pos", ["d0", "t0", "d", "t"], behind=True, width=width_m).join(ends, key)
    p = F.col("found")
    time = F.when(p.isNull(), F.col("end_t")).otherwise(p["t0"] + (p["t"] - p["t0"]) * (F.col("x") - p["d0"]) / F.greatest(p["d"] - p["d0"], F.lit(1e-6)))
    times = written(found.select(*key, F.col("x").alias("distance_m"), time.alias("at")), "times")
    out = asked
    for n in (1, 2):
        out = out.join(times.select("session_id", F.col("lap_number").alias(f"lap{n}"), "distance_m", F.col("at").alias(f"t{n}")), ["session_id", f"lap{n}", "distance_m"], "left")
    return out.select("session_id", "lap1", "lap2", "distance_m", half_up(F.col("t1") - F.col("t2"), 6).alias("delta_s"))


def comparable_laps(laps: DataFrame, chosen: DataFrame) -> DataFrame:
    """The laps of each session but the chosen one."""
    return laps.where("not is_partial").join(chosen.select("session_id", "lap_number"), ["session_id", "lap_number"], "left_anti")

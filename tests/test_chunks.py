"""Any chunk size gives the same rows as a session in one chunk."""

import math
import random

import pytest
from pyspark.sql import functions as F

from apexlap.operators import corners, laps, motion, roads


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(21)
    rows = []
    for s, n in (("a", 157), ("b", 1), ("c", 2), ("d", 64), ("e", 40)):
        ms, lat, lon = 1000.0, 40.0, -80.0
        for i in range(n):
            ms += rng.choice([0.0, 250.0, 1000.0])
            lat, lon = lat + rng.uniform(-1, 1) * 1e-4, lon + rng.uniform(-1, 1) * 1e-4
            gone = rng.random() < 0.15 or (s == "e" and i < 25)
            rows.append((s, i, ms, None if gone else lat, None if gone else lon, rng.choice([None, 3.5, 10.0]), s == "d", 1.5, 2.5, "x", "y"))
    return spark.createDataFrame(rows, "session_id string, sample_idx long, timestamp_ms double, lat double, lon double, speed_mps double, has_accel boolean, imu_accel_x double, imu_accel_y double, turn string, course string").repartition(3)


def same(a, b, key=("session_id", "sample_idx")):
    assert a.columns == b.columns
    left, right = ({tuple(r[k] for k in key): r for r in df.collect()} for df in (a, b))
    assert left.keys() == right.keys()
    for k, r in left.items():
        for c in a.columns:
            x, y = r[c], right[k][c]
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-7)), (k, c, x, y)


@pytest.mark.parametrize(("method", "window"), [("ma", 4), ("gaussian", 7), ("savgol", 4), (None, 1)])
def test_metrics(series, method, window):
    how = {"smooth_position": method is not None, "smooth_method": method or "ma", "smooth_window": window}
    whole = motion.compute_derived_metrics(series, **how)
    for size in (9,):
        same(whole, motion.compute_derived_metrics(series, **how, chunk=size))


def model(idx: list[int], skip: int) -> list[int]:
    last, out = 0, []
    for i in idx:
        if i - last > skip:
            out.append(i)
            last = i
    return out


@pytest.mark.parametrize("size", [1, 8, 1 << 16])
def test_boundaries_compose(spark, size):
    rng = random.Random(size)
    rows, want = [], {}
    for s in range(30):
        near = sorted(rng.sample(range(120), rng.choice([0, 1, 10, 60, 120])))
        skip = rng.choice([0, 1, 4, 9])
        want[str(s)] = (model(near, skip), skip)
        rows += [(str(s), i, 40.0 if i in near else 41.0, -80.0) for i in range(120)]
    t = spark.createDataFrame(rows, "session_id string, sample_idx long, lat double, lon double").repartition(4)
    starts = t.select("session_id", F.lit(40.0).alias("start_lat"), F.lit(-80.0).alias("start_lon")).distinct()
    own = spark.createDataFrame([(k, 5.0, v[1]) for k, v in want.items()], "session_id string, tolerance_m double, skip_samples int")
    got = {r.session_id: list(r.boundaries) for r in laps.lap_boundaries(t, starts, parameters=own, chunk=size).collect()}
    assert {k: v[0] for k, v in want.items() if v[0]} == {k: v for k, v in got.items() if v}


def test_laps_and_paths(spark):
    rng = random.Random(2)
    rows = [(s, i, f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z", 40.0 + rng.uniform(-1, 1) * 1e-3, -80.0 + rng.uniform(-1, 1) * 1e-3, float(i), i * 3.5, "m", "s") for s in "ab" for i in range(100)]
    t = spark.createDataFrame(rows, "session_id string, sample_idx long, timestamp string, lat double, lon double, elapsed_s double, distance_m double, mark string, chunk string").repartition(3)
    bounds = spark.createDataFrame([("a", [10, 40, 41, 77]), ("b", [50])], "session_id string, boundaries array<long>")
    found = laps.classify_laps(laps.lap_records(t, laps.lap_ranges(t, bounds)))
    assert found.count() == 7
    p = t.withColumnsRenamed({"lat": "lat_smooth", "lon": "lon_smooth"})
    centres = spark.createDataFrame([("a", 40.0, -80.0), ("b", 40.0, -80.0)], "session_id string, lat0 double, lon0 double")
    for size in (7,):
        same(laps.lap_samples(t, found), laps.lap_samples(t, found, size), ("session_id", "start_sample_idx", "sample_idx"))
        same(laps.annotate_lap_samples(t, found), laps.annotate_lap_samples(t, found, size))
        same(laps.raw_lap_ids(t, bounds), laps.raw_lap_ids(t, bounds, size))
        same(corners.lap_curvature(t, found), corners.lap_curvature(t, found, chunk=size), ("session_id", "start_sample_idx", "sample_idx"))
        same(roads.track_distance(p, centres), roads.track_distance(p, centres, size))
    ids = {(r.session_id, r.sample_idx): r.lap for r in laps.raw_lap_ids(t, bounds, 7).collect()}
    assert all(ids[("a", i)] == sum(b < i for b in (10, 40, 41, 77)) for i in range(100))


def test_a_long_session_is_many_tasks(spark):
    """No exchange deals samples by session alone."""
    s = spark.range(4000).select(F.lit("a").alias("session_id"), F.col("id").alias("sample_idx"), (F.col("id") * 1000.0).alias("timestamp_ms"), (40 + F.sin(F.col("id") / 40) * 1e-3).alias("lat"), (F.cos(F.col("id") / 40) * 1e-3 - 80).alias("lon"), F.lit(5.0).alias("speed_mps"))
    m = motion.compute_derived_metrics(s, chunk=100)
    last = m.where("sample_idx = 3999").first()
    assert abs(last.distance_along_m - 3999 * 5.0) < 1e-6 and abs(last.heading_deg - m.where("sample_idx = 3998").first().heading_deg) < 3
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = m.select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread == 4

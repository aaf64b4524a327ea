"""Quantiles by refinement, results computed once, road edges from files, log quality."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from apexlap.operators import quantiles, roads
from apexlap.plans import session
from apexlap.sources import edges, export, logs, results


@pytest.mark.parametrize("bins", [16, 1024])
def test_quantiles_are_numpys(spark, bins):
    rng = random.Random(bins)
    groups = {"one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 50, "ties": [float(rng.randint(0, 4)) for _ in range(200)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(60)], "near": [1.0 + i * 2.0**-52 for i in range(20)], "usual": [rng.gauss(0, 5) for _ in range(400)], None: [0.0, 4.0]}
    rows = [(k, v, "x") for k, x in groups.items() if k for v in x] + [("usual", None, "x"), ("usual", float("nan"), "x"), ("usual", float("inf"), "x"), ("none", None, "x")]
    df = spark.createDataFrame(rows, "g string, error_m double, lo string").repartition(3)
    asked = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "error_m", asked, bins).collect()}
    assert set(got) == {k for k in groups if k}
    for k, r in got.items():
        want = np.percentile(groups[k], [100 * p for p in asked.values()])
        assert np.allclose([r[n] for n in asked], want, rtol=1e-12, atol=0), k
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "error_m", asked).count() == 0


def test_accuracy_is_the_same_by_either_way(spark):
    rng = random.Random(4)
    rows = [("s", "m", rng.choice(["raw", "smooth"]), abs(rng.gauss(0, 3))) for _ in range(300)] + [("t", "m", "raw", None)]
    e = spark.createDataFrame(rows, "session_id string, method string, series string, error_m double")
    a, b = ({(r.session_id, r.series): r for r in roads.accuracy(e, percentiles=p).collect()} for p in ("buffered", "refined"))
    assert a.keys() == b.keys() and a[("t", "raw")].n_points == b[("t", "raw")].n_points == 0 and b[("t", "raw")].p90_m is None
    for k in a:
        for m in roads.METRICS:
            assert a[k][m] == b[k][m] or abs(a[k][m] - b[k][m]) < 1e-12
    with pytest.raises(ValueError, match="percentiles"):
        roads.accuracy(e, percentiles="guessed")


def test_results_are_computed_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/store", []
    pairs = lambda *x: spark.createDataFrame(list(x), "session_id string, method string")

    def compute(missing):
        calls.append(sorted(tuple(r) for r in missing.collect()))
        # session c has no rows at all
        return missing.where("session_id != 'c'").select(F.length("method").alias("v"), "session_id", "method")

    wanted = pairs(("a", "ma"), ("b", "ma"), ("c", "ma"), ("a", "ma"), (None, "ma"))
    results.update_results(path, wanted, compute)
    results.update_results(path, wanted, compute)
    results.update_results(path, pairs(("a", "ma"), ("a", "savgol")), compute)
    assert calls == [[("a", "ma"), ("b", "ma"), ("c", "ma")], [("a", "savgol")]]
    rows = results.read_results(spark, path, "v int, session_id string, method string")
    assert sorted(tuple(r) for r in rows.collect()) == [(2, "a", "ma"), (2, "b", "ma"), (6, "a", "savgol")]
    assert "PartitionFilters: [isnotnull(session_id" in rows.where("session_id = 'a'")._jdf.queryExecution().toString()
    # a run that wrote rows but broke off before it listed them is done again, without doubling
    rows.where("session_id = 'b'").select(F.lit(99).alias("v"), F.lit("d").alias("session_id"), "method").write.mode("append").partitionBy("session_id", "method").parquet(f"{path}/rows")
    results.update_results(path, pairs(("d", "ma")), compute)
    rows = results.read_results(spark, path, "v int, session_id string, method string")
    assert [r.v for r in rows.where("session_id = 'd'").collect()] == [2]
    assert [tuple(r) for r in export.stored(spark, f"{path}/rows", "a").where("method = 'ma'").select("v").collect()] == [(2,)]


def test_edges_from_files(spark, tmp_path):
    feature = lambda i, kind, c, k="LineString": json.dumps({"type": "Feature", "properties": {"edge_id": i, "highway": kind, "name": "n"}, "geometry": {"type": k, "coordinates": c}})
    lines = [feature(1, "motorway_link", [[1.0, 2.0], [3, 4, 5]]), feature(2, "service", [[[0, 0], [1, 1]], [[5, 5]]], "MultiLineString"), feature(3, None, [9, 9], "Point"), "no json", "", feature(4, None, [])]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    got = edges.read_road_edges(spark, f"file://{tmp_path}/g.jsonl", "geojson")
    assert sorted((r.edge_id, r.highway, [tuple(p) for p in r.coords]) for r in got.collect()) == [(1, "motorway_link", [(1.0, 2.0), (3.0, 4.0)]), (2, "service", [(0.0, 0.0), (1.0, 1.0)]), (2, "service", [(5.0, 5.0)])]
    got.write.parquet(f"{tmp_path}/p")
    got.write.json(f"{tmp_path}/j")
    for form in ("parquet", "json"):
        assert edges.read_road_edges(spark, f"file://{tmp_path}/{form[0]}", form).count() == 3
    assert [r.edge_id for r in edges.read_road_edges(spark, f"file://{tmp_path}/p", only=roads.MAIN_ROADS).collect()] == [1]
    with pytest.raises(ValueError, match="format"):
        edges.read_road_edges(spark, "x", "shapefile")


HEADERS = {"Fix": ["LatitudeDegrees", "LongitudeDegrees", "SpeedMps", "UnixTimeMillis", "Pad"], "Raw": ["utcTimeMillis", "Pad"]}


def test_quality_and_observation(spark):
    text = {"s": ["# note", "Fix,1,2,3,1000,0", "Raw,5,0", "Fix,1,2", "Odd", "Fix,nan,2,3,4000,0", "Raw", "Fix,1,2,3,x,0"], "t": ["#", "Raw,7,0"], "u": ["none"]}
    lines = spark.createDataFrame([(s, i, x) for s, v in text.items() for i, x in enumerate(v)], "session_id string, line_no long, line string")
    got = {r.session_id: tuple(r)[1:] for r in logs.log_quality(lines, HEADERS).collect()}
    assert got == {"s": (8, 2, 2, 4, 2, 1, True), "t": (2, 1, 0, 1, 0, 0, False), "u": (1, 1, 0, 0, 0, 0, False)}
    seen = Observation("quality")
    series = logs.time_series(logs.parse_records(lines, HEADERS), seen)
    assert series.count() == 3 and seen.get == {"n_records": 7, "n_short": 2, "n_untimed": 2}


def test_trajectory_and_markers(spark):
    rows = [("a", i, 1000.0 * i, 40.0 + max(0, abs((i % 40) - 20) - 2) * 1e-4, -80.0, 12.0) for i in range(200)]
    series = spark.createDataFrame(rows, "session_id string, sample_idx long, timestamp_ms double, lat double, lon double, speed_mps double")
    starts = spark.createDataFrame([("a", 40.0, -80.0)], "file_name string, lat double, lon double")
    samples, found = session.load_trajectory(series, starts)
    laps = sorted((r.lap_number, r.start_sample_idx, r.end_sample_idx, r.is_partial) for r in found.collect())
    assert [x[0] for x in laps] == list(range(1, len(laps) + 1)) and len(laps) > 2 and not any(x[3] for x in laps)
    index = {r.sample_idx: r.lap_index for r in samples.collect()}
    assert all(index[s] == n for n, s, _, _ in laps)
    points = roads.method_points(series, ("ma",))
    centres = roads.reference_points(points, starts)
    got = {(r.lap_number, r.marker): (r.x, r.y) for r in roads.lap_markers(points, found, centres).collect()}
    assert len(got) == 2 * len(laps) and all(abs(x) < 1e-6 and -1e-6 <= y < 250 for x, y in got.values())
    assert roads.reference_points(points, starts).first().lat0 == 40.0


def test_comparison_and_validation_files(spark, tmp_path):
    wide = spark.createDataFrame([("s", "ma", 1.5, 2), ("s", "savgol", None, 0)], "session_id string, Method string, mean_m double, n_points int")
    export.export_comparison_csv(wide, f"file://{tmp_path}/c")
    assert sorted((r.Method, r.mean_m, r.n_points) for r in spark.read.csv(f"file://{tmp_path}/c", header=True).collect()) == [("ma", "1.5", "2"), ("savgol", None, "0")]
    rows = spark.createDataFrame([("s", "ma", 0, "2024", 1.0, 2.0, 3.0, 4.0, 5.0, None)], "session_id string, method string, sample_idx int, timestamp string, lat_raw double, lon_raw double, lat_smooth double, lon_smooth double, dist_error_raw_m double, dist_error_smooth_m double")
    export.export_validation_csv(rows, f"file://{tmp_path}/v")
    (r,) = spark.read.csv(f"file://{tmp_path}/v", header=True).collect()
    assert (r.session_id, r.method, r.timestamp, r.dist_error_raw_m, r.dist_error_smooth_m) == ("s", "ma", 2024, "5.0", None) or r.timestamp == "2024"

"""Track-session operators: hand-made cases, and small sequential models as the truth."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexlap.operators import corners, laps, layers, motion, roads
from apexlap.sources import logs

HEADERS = {"Fix": ["LatitudeDegrees", "LongitudeDegrees", "SpeedMps", "UnixTimeMillis", "Pad"], "Raw": ["utcTimeMillis", "Pad"], "Accel": ["AccelXMps2", "AccelYMps2", "AccelZMps2", "Pad"], "UncalAccel": ["UncalAccelXMps2", "UncalAccelYMps2", "UncalAccelZMps2", "Pad"]}


def test_log_steps(spark):
    text = ["# preamble", "Accel,1,2,3,0", "Fix,40,-80,3,1000,0", "Fix,42,-80,5,,0", "Accel,4,5,6,0", "Accel,7,8,9,0", "Odd", "Fix,nan,x,1,,0", "Raw,3000,0", "Fix"]
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(text)], "session_id string, line_no long, line string")
    rows = logs.time_series(logs.parse_records(lines, HEADERS)).orderBy("sample_idx").collect()
    assert [(r.timestep, r.timestamp_ms, r.lat, r.speed_mps, r.imu_accel_x, r.has_accel) for r in rows] == [(1, 1000.0, 41.0, 4.0, 4.0, True), (2, 3000.0, None, 1.0, None, True)]
    with pytest.raises(Exception, match="short line"):
        logs.parse_records(lines, HEADERS, mode="failfast").collect()


def _series(spark, rows):
    return spark.createDataFrame(rows, "session_id string, sample_idx long, timestamp_ms double, lat double, lon double, speed_mps double")


def test_heading_is_unwrapped(spark):
    rng = np.random.default_rng(3)
    lat, lon = 40 + np.cumsum(rng.normal(size=200)) * 1e-5, -80 + np.cumsum(rng.normal(size=200)) * 1e-5
    m = motion.compute_derived_metrics(_series(spark, [("a", i, i * 1000.0, float(lat[i]), float(lon[i]), 1.0) for i in range(200)]), smooth_position=False).orderBy("sample_idx").toPandas()
    dx, dy = np.diff(m.x_m, prepend=m.x_m[0]), np.diff(m.y_m, prepend=m.y_m[0])
    heading = np.unwrap(np.arctan2(dx, dy))
    assert np.allclose(m.heading_deg, np.degrees(heading))
    assert np.allclose(m.lat_accel_mps2, m.speed_mps * np.gradient(heading, m.elapsed_s))


def test_unknown_method_is_refused(spark):
    with pytest.raises(ValueError, match="unknown smoothing"):
        motion.compute_derived_metrics(_series(spark, [("a", 0, 0.0, 1.0, 1.0, 1.0)]), smooth_method="loess")


def test_boundaries_are_greedy(spark):
    random.seed(5)
    rows, expected = [], {}
    for s in range(20):
        near = [random.random() < 0.4 for _ in range(60)]
        last, found = 0, []
        for i, x in enumerate(near):
            if x and i - last > 4:
                found.append(i)
                last = i
        expected[str(s)] = found
        rows += [(str(s), i, 40.0 if x else 41.0, -80.0) for i, x in enumerate(near)]
    t = spark.createDataFrame(rows, "session_id string, sample_idx long, lat double, lon double")
    starts = t.select("session_id", F.lit(40.0).alias("start_lat"), F.lit(-80.0).alias("start_lon")).distinct()
    got = {r.session_id: list(r.boundaries) for r in laps.lap_boundaries(t, starts).collect()}
    assert got == {k: v for k, v in expected.items() if any(v) or k in got}


def test_corner_scan(spark):
    random.seed(9)
    rows, expected = [], set()
    for s in range(150):
        k = [random.choice([0, 2, 4, 7, -4, -7]) * 1e3 for _ in range(25)] + [0.0]
        i, n = 0, 0
        while i < len(k):
            if abs(k[i]) >= 6e3:
                a = i
                while a > 0 and a >= i and abs(k[a]) > 3e3 and math.copysign(1, k[a]) == math.copysign(1, k[i]):
                    a -= 1
                while a > 0 and abs(k[a]) > 3e3 and math.copysign(1, k[a]) == math.copysign(1, k[i]):
                    a -= 1
                b = i
                while b < len(k) - 1 and abs(k[b]) > 3e3 and math.copysign(1, k[b]) == math.copysign(1, k[i]):
                    b += 1
                n += 1
                expected.add((s, n, a, b))
                i = b + 1
            else:
                i += 1
        rows += [(str(s), 1, 0, len(k) - 1, i, float(x)) for i, x in enumerate(k)]
    c = spark.createDataFrame(rows, "session_id string, lap_number int, start_sample_idx long, end_sample_idx long, pos long, k double")
    got = {(int(r.session_id), r.corner_id, r.a, r.b) for r in corners.corner_ranges(c).collect()}
    assert got == expected


def test_two_laps_leave_no_full_lap(spark):
    r = spark.createDataFrame([("a", 0, 9), ("a", 9, 20), ("b", 0, 5)], "session_id string, start_sample_idx long, end_sample_idx long")
    got = {(x.session_id, x.lap_number, x.is_partial) for x in laps.classify_laps(r).collect()}
    assert got == {("a", 1, True), ("a", 2, True), ("b", 1, False)}


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    for name in ("b_one.txt", "a_two.txt", "headers.txt"):
        (tmp_path / name).write_text("\n".join(f"{name} {i}" for i in range(5000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    rows = logs.read_log_lines(spark, f"file://{tmp_path}/a_two.txt").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_no, r.line) for r in rows) == [(i, f"a_two.txt {i}") for i in range(5000)]
    assert [tuple(r) for r in logs.list_datasets(spark, f"file://{tmp_path}").collect()] == [("a_two.txt", "A Two"), ("b_one.txt", "B One")]


def test_headers_and_starts(spark, tmp_path):
    (tmp_path / "h.txt").write_text("Fix,a,b\n\nRaw,c\nFix,d\n")
    assert logs.read_headers(spark, f"file://{tmp_path}/h.txt") == {"Fix": ["d"], "Raw": ["c"]}
    (tmp_path / "s.csv").write_text("File Name,Lat,Long\n one.txt , 40.5s,-80\n,1,2\ntwo.txt,x,1\n")
    assert [tuple(r) for r in logs.read_track_starts(spark, f"file://{tmp_path}/s.csv").collect()] == [("one.txt", 40.5, -80.0)]


def test_radius_far_north(spark):
    import math as m

    lat, km = 70.0, 4.9
    lon = km / (111.195 * m.cos(m.radians(lat)))
    edges = spark.createDataFrame([(1, "primary", [(lon, lat), (lon + 0.01, lat)]), (2, "service", [(5.0, lat)])], "edge_id long, highway string, coords array<struct<lon:double,lat:double>>")
    centres = spark.createDataFrame([("s", lat, 0.0), ("t", None, None)], "session_id string, lat0 double, lon0 double")
    assert [r.edge_id for r in roads.roads_in_radius(centres, edges, 500.0).collect()] == [1]


def test_road_errors_reach_far_and_keep_nulls(spark):
    centres = spark.createDataFrame([("s", 40.0, -80.0), ("none", 40.0, -80.0)], "session_id string, lat0 double, lon0 double")
    points = spark.createDataFrame([("s", "m", 0, "raw", 40.0, -80.0), ("s", "m", 1, "raw", 40.5, -80.0), ("s", "m", 2, "raw", None, 1.0), ("none", "m", 0, "raw", 40.0, -80.0)], "session_id string, method string, sample_idx long, series string, lat double, lon double")
    edges = spark.createDataFrame([("s", 1, [(-80.001, 40.0), (-80.001, 40.2)]), ("s", 1, [(-80.001, 40.0), (-80.001, 40.2)])], "session_id string, edge_id long, coords array<struct<lon:double,lat:double>>")
    got = {(r.session_id, r.sample_idx): r.error_m for r in roads.road_errors(points, edges, centres).collect()}
    assert got[("s", 2)] is None and got[("none", 0)] is None
    assert abs(got[("s", 0)] - 85.3) < 0.5 and abs(got[("s", 1)] - 33396) < 200


def _telemetry(spark, n=60):
    rows = [("a", i, f"2024-01-01T00:00:{i:02d}.000Z", 40.0 + abs((i % 20) - 10) * 1e-4, -80.0, float(i), float(i), 10.0 + i % 7, 1.0, -1.0, "x", "y") for i in range(n)] + [("none", 0, "2024-01-01T00:00:00.000Z", None, None, 0.0, 0.0, 0.0, 0.0, 0.0, "x", "y")]
    return spark.createDataFrame(rows, "session_id string, sample_idx long, timestamp string, lat double, lon double, elapsed_s double, distance_m double, speed_mph double, long_accel_mps2 double, lat_accel_mps2 double, lap_number string, pos string")


def test_clashing_columns_and_missing_positions(spark):
    t = _telemetry(spark)
    found = laps.detect_laps(t)
    assert {r.session_id for r in found.collect()} == {"a"}  # a session of one sample has no lap
    assert laps.lap_samples(t, found).where("pos < 0").count() == 0
    assert laps.annotate_lap_samples(laps.annotate_lap_samples(t, found), found).count() == 61
    docs = {r.session_id: r for r in layers.track_geojson(t).collect()}
    line, marker = json.loads(docs["a"].geojson)["features"]
    assert line["geometry"]["coordinates"][0] == [-80.0, 40.001] and line["properties"]["sampleCount"] == 60 and marker["properties"]["marker"] == "start_finish"
    assert docs["none"].geojson is None and docs["none"].error
    features = [json.loads(r.feature) for r in layers.lap_features(t, found).collect()]
    assert features and all(f["geometry"]["type"] == "LineString" and f["properties"]["lap_time_s"] > 0 for f in features)
    assert corners.detect_corners(t, found).count() >= 0 and layers.heatmap_layers(t).where("session_id = 'none'").count() == 0


def test_empty_tables(spark):
    t = _telemetry(spark).limit(0)
    found = laps.detect_laps(t)
    for df in (found, laps.lap_samples(t, found), laps.sector_times(t, found), laps.annotate_lap_samples(t, found), corners.detect_corners(t, found), layers.track_geojson(t), layers.lap_features(t, found), layers.heatmap_layers(t), laps.plausible_laps(t, found)):
        assert df.count() == 0


def test_corner_geometry_is_lon_lat(spark):
    rows = [("a", i, f"2024-01-01T00:00:{i:02d}.000Z", 40.0 + max(0, i - 10) * 1e-4, -80.0 + min(i, 10) * 1e-4, float(i), float(i), float(20 - i % 3), 2.0) for i in range(21)]
    t = spark.createDataFrame(rows, "session_id string, sample_idx long, timestamp string, lat double, lon double, elapsed_s double, distance_m double, speed_mph double, lat_accel_mps2 double")
    found = spark.createDataFrame([("a", 1, 0, 20)], "session_id string, lap_number int, start_sample_idx long, end_sample_idx long")
    got = corners.detect_corners(t, found, 3e3, 1e3).collect()
    assert got and all(p[0] < 0 < p[1] for r in got for p in r.geometry) and got[0].max_lat_g == 0.204


def test_session_document_is_in_order(spark):
    from apexlap.sources import export

    rows = spark.createDataFrame([("s", i, i * 2) for i in (11, 2, 0, 10, 1)], "session_id string, sample_idx long, v long")
    track = spark.createDataFrame([("s", '{"a":1}'), ('q"', None)], "session_id string, geojson string")
    got = {r.session_id: json.loads(r.document) for r in export.session_documents({"track": track, "telemetry": rows}).collect()}
    assert [x["sample_idx"] for x in got["s"]["telemetry"]] == [0, 1, 2, 10, 11] and got["s"]["track"] == {"a": 1}
    assert got['q"'] == {"session_id": 'q"', "track": None, "telemetry": []}


def test_shared_folder_must_be_set(spark):
    from apexlap.sources import staging

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        staging.shared_dir(Elsewhere)


@pytest.mark.parametrize("name", ["laps", "corners", "smoothing", "sectors", "lap_features", "track_geojson", "log_files", "lap_deltas", "session_documents", "error_histogram"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    from apexlap.plans import registry

    con = duckdb.connect()
    for t in ("events", "part"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(registry.SQL[name])
    names = [x[0] for x in cur.description]
    clean = lambda rows, at: sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows], key=str)
    assert clean(df.collect(), range(len(df.columns))) == clean(cur.fetchall(), [names.index(c) for c in df.columns])

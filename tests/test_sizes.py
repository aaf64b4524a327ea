"""Work that must grow with the input, not with the square of a group or the size of one row."""

import json
import threading
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from apexlap.operators import nearest, roads
from apexlap.plans import fixtures, session
from apexlap.sources import export


@contextmanager
def seconds_at_most(spark, seconds: float):
    """Jobs that still run by then are cancelled, which raises."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_many_points_at_few_places_with_many_samples(spark):
    """80,000 points by 200,000 samples in two neighbouring cells: 1.6e10 pairs, but 4 x 5 places."""
    place = lambda n: (F.lit(40.0) + F.col("id") % n * F.lit(1e-5)).alias("lat")
    samples = spark.range(200_000).select(F.lit("a").alias("session_id"), F.col("id").alias("sample_idx"), place(5), F.lit(-80.0).alias("lon"))
    points = spark.range(80_000).select(F.lit("a").alias("session_id"), F.col("id").alias("point_id"), place(4), F.lit(-80.00001).alias("lon"))
    with seconds_at_most(spark, 60):
        got = nearest.nearest_samples(points, samples)
        rows = got.groupBy((F.col("point_id") % 4).alias("place"), "sample_idx").count().collect()
    assert sorted((r.place, r.sample_idx, r["count"]) for r in rows) == [(k, k, 20_000) for k in range(4)]


def test_many_points_at_few_places_by_many_segments(spark):
    """1,500,000 points at 3 places, each with 600 segments in its cell: a place is measured once."""
    points = spark.range(1_500_000).select(F.lit("a").alias("session_id"), F.lit("m").alias("method"), F.col("id").alias("sample_idx"), F.lit("raw").alias("series"), (F.lit(40.0) + F.col("id") % 3 * F.lit(1e-5)).alias("lat"), F.lit(-80.0).alias("lon"))
    step = lambda j: F.struct((F.lit(-80.0) + (F.col("id") + j) * F.lit(1e-8)).alias("lon"), F.lit(40.0).alias("lat"))
    edges = spark.range(600).select(F.lit("a").alias("session_id"), F.col("id").alias("edge_id"), F.array(step(0), step(1)).alias("coords"))
    centres = spark.createDataFrame([("a", 40.0, -80.0)], "session_id string, lat0 double, lon0 double")
    with seconds_at_most(spark, 60):
        rows = roads.road_errors(points, edges, centres).groupBy((F.col("sample_idx") % 3).alias("place"), F.round("error_m", 2).alias("error_m")).count().collect()
    assert sorted((r.place, r.error_m, r["count"]) for r in rows) == [(k, round(k * 1.11474, 2), 500_000) for k in range(3)]


def test_roads_are_searched_where_none_is_known(spark, monkeypatch):
    edge = lambda i, kind, lat: (i, kind, [(-80.0, lat), (-79.9999, lat)])
    edges = spark.createDataFrame([edge(1, "primary", 40.0), edge(2, "residential", 50.004), edge(3, "primary", 60.009), edge(4, "primary", 41.0)], "edge_id long, highway string, coords array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(s, 0, "m", lat, -80.0, lat, -80.0) for s, lat in (("box", 40.0), ("radius", 50.0), ("wide", 60.0), ("none", 10.0))], "session_id string, sample_idx long, method string, lat_raw double, lon_raw double, lat_smooth double, lon_smooth double")
    centres = roads.reference_points(points)
    got = {(r.session_id, r.edge_id) for r in roads.roads_of_sessions(points, edges, centres, 60.0).collect()}
    assert got == {("box", 1), ("radius", 2), ("wide", 3)}
    monkeypatch.setattr(roads, "roads_in_radius", None)
    box = points.where("session_id = 'box'")
    assert {(r.session_id, r.edge_id) for r in roads.roads_of_sessions(box, edges, roads.reference_points(box)).collect()} == {("box", 1)}


def test_times_of_sessions_beyond_two_million_samples(spark):
    """Places in a session count as longs, so that milliseconds don't overflow."""
    late = fixtures._numbered(spark, "/root/testdata/sf0.001").withColumn("rn", F.col("rn") + F.lit(2_200_000))
    rows = late.select("rn", fixtures._milliseconds().alias("ms")).collect()
    steps = {r.rn: r.rn - (r.rn % 50 == 49) for r in rows}
    assert rows and all(r.ms == 1700000000000 + steps[r.rn] * 1000 + 13 * (steps[r.rn] % 7) for r in rows)


def test_exported_laps_share_folders(spark, tmp_path):
    empty = [F.lit(None).cast("double").alias(c) for c in export.LAP_COLUMNS if c not in ("lap_number", "timestamp", "lap_elapsed_s")]
    samples = spark.range(2_401).select(F.lit("7").alias("session_id"), F.col("id").alias("sample_idx"), F.lit("t").alias("timestamp"), F.col("id").cast("double").alias("lap_elapsed_s"), *empty)
    laps = spark.range(1_200).select(F.lit("7").alias("session_id"), (F.col("id") + 1).cast("int").alias("lap_number"), F.lit(False).alias("is_partial"), (F.col("id") * 2).alias("start_sample_idx"), (F.col("id") * 2 + 2).alias("end_sample_idx"))
    export.export_lap_csv(samples, laps, f"file://{tmp_path}/all")
    files = sorted((tmp_path / "all").rglob("*.csv"))
    assert [f.parent.name for f in files] == ["laps_from=1", "laps_from=1001"]
    with files[1].open() as f:
        lines = f.read().split()
    assert lines[0] == ",".join(export.LAP_COLUMNS)
    assert [(int(x.split(",")[1]), float(x.split(",")[2])) for x in lines[1:]] == [(lap, float(2 * lap - 2 + k)) for lap in range(1001, 1201) for k in range(3)]
    export.export_lap_csv(samples, laps, f"file://{tmp_path}/one", 1100)
    assert spark.read.csv(f"file://{tmp_path}/one", header=True).select("lap_number").distinct().collect() == [("1100",)]
    with pytest.raises(ValueError, match="no lap"):
        export.export_lap_csv(samples, laps, f"file://{tmp_path}/none", 5000)


def test_documents_in_parts_are_the_whole_ones(spark, tmp_path):
    series = fixtures.tracks(spark, "/root/testdata/sf0.001").where("session_id in ('1', '2')")
    starts = spark.createDataFrame([("1", 40.0, -80.0), ("2", 40.0, -80.0)], "file_name string, lat double, lon double")
    whole = {r.session_id: json.loads(r.document) for r in export.session_documents(session.build_sessions(series, starts)).collect()}
    parts = session.build_sessions(series, starts, whole=False)
    rows = export.document_parts(parts, 8).orderBy("session_id", "at").collect()
    assert max(r.n for r in rows) <= 8 and len(rows) > 60
    for k, document in whole.items():
        assert json.loads("".join(r.text for r in rows if r.session_id == k)) == document
        assert len(document["telemetry"]) > 8 and document["track"]["features"][0]["geometry"]["coordinates"]
        for name in ("telemetry", "laps", "heatmap"):
            mine = [r for r in rows if r.session_id == k and r.result == name and r.n]
            assert [r.first for r in mine] == [sum(x.n for x in mine[:i]) for i in range(len(mine))]
    export.export_sessions_json(parts, f"file://{tmp_path}/json")
    for k, document in whole.items():
        files = sorted((tmp_path / "json" / f"session_id={k}").glob("*.txt"))
        assert json.loads("".join(f.read_text() for f in files)) == document

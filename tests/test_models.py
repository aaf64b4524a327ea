"""Operators against sequential models and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from apexlap.operators import asof, corners, deltas, laps, nearest, roads

EARTH = 6371000.0


def model_laps(near: list[bool | None], skip: int = 4) -> list[tuple[int, int, int, bool]]:
    """(lap number, first, last sample, partial), sample by sample; None has no position."""
    ranges, since, start = [], 0, 0
    for i, x in enumerate(near):
        if x is None:
            since += 1
            continue
        if x and since > skip:
            ranges.append((start, i))
            since, start = 0, i
        since += 1
    ranges.append((start, len(near) - 1))
    found = [(k + 1, s, e) for k, (s, e) in enumerate(ranges) if e > s]
    if len(found) < 2:
        return [(*x, False) for x in found]
    return [(*found[0], True), *((n - 1, s, e, False) for n, s, e in found[1:-1]), (*found[-1], True)]


def session(spark, rows):
    return spark.createDataFrame(rows, "session_id string, sample_idx long, timestamp string, lat double, lon double, distance_m double, elapsed_s double, lap_time_s double, chunk long, own string")


def stamp(i: int) -> str:
    return f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z"


def test_laps_are_the_models(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for k in range(40):
        near = [rng.choice([True, False, False, None]) if rng.random() < 0.5 else False for _ in range(rng.randint(1, 70))]
        if k < 6:
            near = [[None], [False, False], [None] * 5, [True] * 40, [False] * 9 + [True], [False] * 9 + [True, False]][k]
        want |= {(str(k), *x) for x in model_laps(near)}
        rows += [(str(k), i, stamp(i), None if x is None else 40.0 if x else 41.0, -80.0, i * 10.0, float(i), 0.0, 0, "") for i, x in enumerate(near)]
    t = session(spark, rows)
    starts = t.select(F.col("session_id").alias("file_name"), F.lit(40.0).alias("lat"), F.lit(-80.0).alias("lon"))
    got = {(r.session_id, r.lap_number, r.start_sample_idx, r.end_sample_idx, r.is_partial) for r in laps.detect_laps(t, starts).collect()}
    assert got == want and sum(1 for x in want if x[4]) > 30 and sum(1 for x in want if not x[4]) > 40


def model_corners(k: list[float], high: float, low: float) -> list[tuple[int, int]]:
    """First and last place of each corner in an array of curvature."""
    out, i = [], 0
    while i < len(k):
        if abs(k[i]) >= high:
            b = i
            while b < len(k) - 1 and abs(k[b]) > low and (k[b] > 0) == (k[i] > 0):
                b += 1
            a = i
            while a > 0 and abs(k[a]) > low and (k[a] > 0) == (k[i] > 0):
                a -= 1
            out.append((a, b))
            i = b
        i += 1
    return out


@pytest.mark.parametrize("spread", [1, 2])
def test_corners_are_the_models(spark, spread):
    """The array begins with the first sample whose curvature is known."""
    rng = random.Random(spread)
    rows, want = [], set()
    for s in range(60):
        n = rng.randint(2 * spread + 1, 40)
        k = [rng.choice([0, 2, 4, 7, -4, -7]) * 1e3 if spread <= i < n - 1 - spread else 0.0 for i in range(n)]
        local = [*k[spread:], *[0.0] * spread]
        want |= {(s, c + 1, a + spread, b + spread) for c, (a, b) in enumerate(model_corners(local, 6e3, 3e3))}
        rows += [(str(s), 1, 0, n - 1, i, float(x)) for i, x in enumerate(k)]
    c = spark.createDataFrame(rows, "session_id string, lap_number int, start_sample_idx long, end_sample_idx long, pos long, k double")
    got = {(int(r.session_id), r.corner_id, r.a, r.b) for r in corners.corner_ranges(c, first=spread).collect()}
    assert got == want and any(a == spread for _, _, a, _ in want)


def test_a_circle_is_one_corner_from_the_first_known_sample(spark):
    r = 2e-4
    rows = [("a", i, stamp(i), 40 + r * math.sin(i / 5), -80 + r * math.cos(i / 5), i * 1.0, i * 1.0, 0.0, 0, "") for i in range(30)]
    t = session(spark, rows).withColumns({"speed_mph": F.lit(1.0), "lat_accel_mps2": F.lit(1.0)})
    found = spark.createDataFrame([("a", 1, 0, 29)], "session_id string, lap_number int, start_sample_idx long, end_sample_idx long")
    (corner,) = corners.detect_corners(t, found, 3e3, 1e3, 2).collect()
    assert (corner.a, corner.b) == (2, 27)


def model_time(samples: list[tuple[float, float]], x: float) -> float | None:
    """Time at a distance among (distance, time) in order of time."""
    s = sorted(samples, key=lambda p: p[0])
    if len(s) < 2:
        return None
    for (d0, t0), (d1, t1) in zip(s, s[1:]):
        if x <= d1:
            return t0 + (x - d0) / max(d1 - d0, 1e-6) * (t1 - t0)
    return s[-1][1]


@pytest.mark.parametrize("width", [1.0, 40.0])
def test_delta_at_distance_is_the_models(spark, width):
    rng = random.Random(int(width))
    rows, found, samples = [], [], {}
    for s in range(6):
        ends = [0, 30, 55, 56, 57, 90][: rng.randint(3, 6)]
        place, marks = 0.0, {}
        for lap, (a, b) in enumerate(zip(ends, ends[1:]), start=1):
            found.append((str(s), lap, False, a, b, float(b - a)))
            for i in range(a, b + (b == ends[-1])):
                marks[i] = (0.0 if i == a else place, float(i - a))
                place = 0.0 if i == a else place
                place += rng.choice([0.0, 0.0, 3.5, 12.25, 30.0])
            place = 0.0
        for lap, (a, b) in enumerate(zip(ends, ends[1:]), start=1):
            samples[(str(s), lap)] = [marks[i] for i in range(a, b + 1)]
        rows += [(str(s), i, stamp(i), 40.0, -80.0, 0.0, 0.0, d, t) for i, (d, t) in marks.items()]
    t = spark.createDataFrame(rows, "session_id string, sample_idx long, timestamp string, lat double, lon double, distance_m double, elapsed_s double, lap_distance_m double, lap_elapsed_s double")
    table = spark.createDataFrame(found, "session_id string, lap_number int, is_partial boolean, start_sample_idx long, end_sample_idx long, lap_time_s double")
    asked = [(str(s), a, b, x) for s in range(6) for a in range(1, 7) for b in (1, 2) for x in (-5.0, 0.0, 3.5, 17.0, 100.0, 9999.0)] + [("0", 1, 2, None), ("0", 1, 2, float("nan")), ("0", 1, 2, 17.0)]
    q = spark.createDataFrame(asked, "session_id string, lap1 int, lap2 int, distance_m double")
    got = {(r.session_id, r.lap1, r.lap2, r.distance_m): r.delta_s for r in deltas.delta_at_distance(t, table, q, width).collect() if r.distance_m is not None and r.distance_m == r.distance_m}
    for s, a, b, x in asked[:-3]:
        one, two = (model_time(samples[(s, n)], x) if (s, n) in samples else None for n in (a, b))
        want = None if one is None or two is None else one - two
        assert (got[(s, a, b, x)] is None) == (want is None) and (want is None or abs(got[(s, a, b, x)] - want) < 1e-5)
    assert deltas.delta_at_distance(t, table, q.limit(0)).count() == 0


@pytest.mark.parametrize("behind", [False, True])
def test_as_of_in_bins(spark, behind):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(rng.randint(-60, 60)) / 2, i) for i in range(150)]
    asked = [(i, rng.choice("abc"), float(rng.randint(-80, 80)) / 2) for i in range(200)] + [(200, "a", None), (201, "a", float("nan"))]
    r = spark.createDataFrame([*rows, ("a", None, 900)], "k string, d double, i long")
    q = spark.createDataFrame(asked, "id long, k string, x double")
    got = {x.id: x.found.i if x.found else None for x in asof.as_of(q, r, ["k"], "x", "d", "i", ["i"], behind, 7.0).collect()}
    for n, k, x in asked:
        hits = [] if x is None or x != x else [(d, i) for j, d, i in rows if j == k and (d >= x if behind else d <= x)]
        assert got[n] == ((min(hits) if behind else max(hits))[1] if hits else None)


def test_untimed_laps_are_not_compared(spark):
    rows = [("a", i, stamp(i), 40.0, -80.0, 0.0, 0.0, float(i % 10), float(i % 10)) for i in range(30)]
    t = spark.createDataFrame(rows, "session_id string, sample_idx long, timestamp string, lat double, lon double, distance_m double, elapsed_s double, lap_distance_m double, lap_elapsed_s double")
    table = spark.createDataFrame([("a", 1, False, 0, 9, 9.0), ("a", 2, False, 10, 19, 8.0), ("a", 3, False, 20, 29, 0.0), ("a", 4, False, 20, 29, None)], "session_id string, lap_number int, is_partial boolean, start_sample_idx long, end_sample_idx long, lap_time_s double")
    assert {(r.lap_number, r.reference_lap) for r in deltas.lap_delta_traces(t, table).collect()} == {(1, 2)}


def metres(a: float, b: float, c: float, d: float) -> float:
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_nearest_is_brute_force(spark):
    rng = random.Random(13)
    places = {"city": (40.0, -80.0, 0.01), "north": (78.0, 20.0, 0.02), "line": (5.0, 179.999, 0.004), "globe": (0.0, 0.0, 80.0), "one": (1.0, 1.0, 0.0)}
    samples, points, n = [], [], 0
    for k, (lat, lon, wide) in places.items():
        mine = [(lat + rng.uniform(-wide, wide), (lon + rng.uniform(-wide, wide) + 180) % 360 - 180) for _ in range(1 if k == "one" else 150)]
        samples += [(k, i, a, b) for i, (a, b) in enumerate([*mine, *mine[:20]])]
        spots = [(lat + rng.uniform(-2, 2) * wide, lon + rng.uniform(-2, 2) * wide) for _ in range(25)]
        spots += [(lat + 0.009, lon), (lat, lon + 0.02), (lat - 1, lon + 3), (-lat, lon - 120), (89.9, 0.0), mine[0]]
        for a, b in spots:
            points.append((k, n, max(-90.0, min(90.0, a)), b))
            n += 1
    odd = [("city", n, None, 1.0), ("city", n + 1, float("nan"), 1.0), ("city", n + 2, 40.0, float("inf")), ("nowhere", n + 3, 1.0, 1.0), points[0]]
    s = spark.createDataFrame([*samples, ("city", 900, None, None), ("city", 901, float("nan"), -80.0)], "session_id string, sample_idx long, lat double, lon double")
    p = spark.createDataFrame([(*r, 1, "x") for r in [*points, *odd]], "session_id string, point_id long, lat double, lon double, level int, one string")
    got = {r.point_id: (r.sample_idx, r.distance_m) for r in nearest.nearest_samples(p, s).collect()}
    assert len(got) == len(points)
    for k, i, a, b in points:
        d, idx = min((round(metres(a, b, c, e), 6), j) for q, j, c, e in samples if q == k)
        assert abs(got[i][1] - d) < 1e-4 and (got[i][0] == idx or abs(metres(a, b, *next((c, e) for q, j, c, e in samples if q == k and j == got[i][0])) - d) < 1e-4)
    assert nearest.nearest_samples(p.limit(0), s).count() == 0 and nearest.nearest_samples(p, s.limit(0)).count() == 0


def test_road_errors_are_brute_force(spark):
    rng = random.Random(17)
    lat0, lon0 = 40.0, -80.0
    n = 6378137.0 / math.sqrt(1 - 6.69437999014e-3 * math.sin(math.radians(lat0)) ** 2)
    plane = lambda lat, lon: (math.radians(lon - lon0) * math.cos(math.radians(lat0)) * n, math.radians(lat - lat0) * n)
    edges = []
    for i in range(120):
        a = (lat0 + rng.uniform(-0.01, 0.01), lon0 + rng.uniform(-0.01, 0.01))
        steps = [a, *((a[0] + rng.uniform(-1, 1) * r, a[1] + rng.uniform(-1, 1) * r) for r in rng.choice([[1e-4], [1e-3, 1e-5], [0.01], [0.0]]))]
        edges.append(("s", i, [(lon, lat) for lat, lon in steps]))
    edges.append(("s", 500, [(lon0 - 3.0, lat0 + 0.05), (lon0 + 3.0, lat0 + 0.06)]))
    points = [(lat0 + rng.uniform(-0.012, 0.012), lon0 + rng.uniform(-0.012, 0.012)) for _ in range(150)]
    points += [(lat0 - 0.02, lon0), (lat0 - 0.5, lon0 + 1.0), (lat0 - 20, lon0 + 60.0), (lat0 + 0.009, lon0 - 0.03), points[0], points[0]]
    rows = [("s", "m", i, "raw", *x) for i, x in enumerate(points)] + [("s", "m", 900, "raw", float("nan"), lon0), ("s", "m", 901, "raw", None, lon0), ("s", "m", 902, "raw", float("inf"), lon0), ("t", "m", 0, "raw", lat0, lon0), ("u", "m", 0, "raw", lat0, lon0)]
    p = spark.createDataFrame([(*r, 1, "x") for r in rows], "session_id string, method string, sample_idx long, series string, lat double, lon double, level int, near string")
    e = spark.createDataFrame([*edges, ("s", 501, [(lon0, float("nan")), (lon0, lat0)])], "session_id string, edge_id long, coords array<struct<lon:double,lat:double>>")
    centres = spark.createDataFrame([("s", lat0, lon0), ("t", lat0, lon0)], "session_id string, lat0 double, lon0 double")
    got = {(r.session_id, r.sample_idx): r.error_m for r in roads.road_errors(p, e, centres).collect()}
    assert len(got) == len(rows) and all(got[k] is None for k in (("s", 900), ("s", 901), ("s", 902), ("t", 0), ("u", 0)))

    def far(x, y, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy) if dx or dy else 0.0
        t = max(0.0, min(1.0, t))
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    for i, x in enumerate(points):
        want = min(far(*plane(*x), plane(c[j][1], c[j][0]), plane(c[j + 1][1], c[j + 1][0])) for _, _, c in edges for j in range(len(c) - 1))
        assert abs(got[("s", i)] - want) < 1e-6 * max(1.0, want)


def test_road_classes_and_radius(spark):
    point = lambda x, y: (-80.0 + x, 40.0 + y)
    edges = [(1, "motorway_link", [point(0, 0.0045), point(0.001, 0.0045)]), (2, "footway", [point(0, 0), point(0.0001, 0)]), (3, "residential", [point(-0.05, 0.003), point(0.05, 0.003)]), (4, None, [point(0.0, 0.004)])]
    e = spark.createDataFrame(edges, "edge_id long, highway string, coords array<struct<lon:double,lat:double>>")
    assert {r.edge_id for r in roads.of_classes(e, roads.MAIN_ROADS).collect()} == {1}
    centres = spark.createDataFrame([("s", 40.0, -80.0), ("n", None, None)], "session_id string, lat0 double, lon0 double")
    # the long residential road has no vertex within 4 km, but passes at 333 m
    assert {(r.session_id, r.edge_id) for r in roads.roads_in_radius(centres, e, 400.0).collect()} == {("s", 3)}
    assert {r.edge_id for r in roads.roads_in_radius(centres, e.where("edge_id in (2, 4)"), 400.0).collect()} == {4}
    assert {r.edge_id for r in roads.roads_in_radius(centres, e.where("edge_id = 2"), 400.0).collect()} == {2}
    points = spark.createDataFrame([("s", 40.0, -80.0), ("s", 40.004, -80.0)], "session_id string, lat_raw double, lon_raw double")
    assert {r.edge_id for r in roads.roads_in_box(points, e).collect()} == {1, 3, 4}
    assert {r.edge_id for r in roads.roads_in_box(points, e, 0.01, roads.MAIN_ROADS).collect()} == {1}

"""Position error against roads, and the comparison of smoothing methods on it.

Points without a position have a NULL error and count in no metric; sessions
without roads have NULL errors throughout. Roads of fewer than two points have
no segment; repeated edges count once. Equal distances and metrics go to the
first method in order. Empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import geometry_to_enu, latlon_to_enu, point_segment_m
from ..functions.numbers import finite
from ..functions.smoothing import reach
from ..sources.staging import written
from .chunks import CHUNK, add_running_sums, chunk_window, in_chunks, own_rows
from .motion import positions_in_chunks, with_smoothed
from .quantiles import exact_quantiles

#: Patterns of road classes; links of a class match with it.
MAIN_ROADS = "motorway|trunk|primary|secondary|tertiary"
NOT_DRIVEN = "abandoned|bridleway|bus_guideway|construction|corridor|cycleway|elevator|escalator|footway|^no$|path|pedestrian|planned|platform|proposed|raceway|razed|service|steps|track"
#: Cell sizes of the search for roads, each four times the one before; the last spans the globe.
LEVELS = 11
METRICS = ["n_points", "mean_m", "rms_m", "std_m", "median_m", "p50_m", "p75_m", "p90_m", "p95_m", "p99_m", "max_m", "min_m"]
COMPARED = ["mean_m", "rms_m", "std_m", "median_m", "p90_m", "p95_m", "max_m"]


def reference_points(points: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """session_id, lat0, lon0: the start table's row, else the mean smoothed position."""
    own = points.groupBy("session_id").agg(F.avg("lat_smooth").alias("lat0"), F.avg("lon_smooth").alias("lon0"))
    if starts is None:
        return own
    s = starts.groupBy(F.col("file_name").alias("session_id")).agg(F.first("lat").alias("slat"), F.first("lon").alias("slon"))
    return own.join(s, "session_id", "left").select("session_id", F.coalesce("slat", "lat0").alias("lat0"), F.coalesce("slon", "lon0").alias("lon0"))


def of_classes(edges: DataFrame, only: str | None = None, without: str | None = None) -> DataFrame:
    """Edges whose highway matches a pattern anywhere, or doesn't; a NULL class matches nothing."""
    if only:
        edges = edges.where(F.col("highway").rlike(only))
    return edges.where(~F.coalesce(F.col("highway"), F.lit("")).rlike(without)) if without else edges


def roads_in_box(points: DataFrame, edges: DataFrame, margin: float = 0.001, only: str | None = None) -> DataFrame:
    """session_id with each edge for driving (and of the classes of `only`) whose box meets that of the session's track."""
    box = points.groupBy("session_id").agg(F.min("lat_raw").alias("a"), F.max("lat_raw").alias("b"), F.min("lon_raw").alias("c"), F.max("lon_raw").alias("d"))
    e = of_classes(edges, only, NOT_DRIVEN)
    ends = {n: F.expr(f"array_{f}(transform(coords, p -> p.{x}))") for n, f, x in (("la", "min", "lat"), ("lb", "max", "lat"), ("lc", "min", "lon"), ("ld", "max", "lon"))}
    cell = F.lit(0.05)
    e = e.withColumns(ends).withColumn("y", F.explode(F.sequence(F.floor(F.col("la") / cell), F.floor(F.col("lb") / cell)))).withColumn("x", F.explode(F.sequence(F.floor(F.col("lc") / cell), F.floor(F.col("ld") / cell))))
    t = box.select("session_id", (F.col("a") - margin).alias("a"), (F.col("b") + margin).alias("b"), (F.col("c") - margin).alias("c"), (F.col("d") + margin).alias("d"))
    t = t.withColumn("y", F.explode(F.sequence(F.floor(F.col("a") / cell), F.floor(F.col("b") / cell)))).withColumn("x", F.explode(F.sequence(F.floor(F.col("c") / cell), F.floor(F.col("d") / cell))))
    met = t.join(e, ["x", "y"]).where("la <= b and lb >= a and lc <= d and ld >= c")
    return met.select("session_id", "edge_id", "highway", "coords").dropDuplicates(["session_id", "edge_id"])


def roads_in_radius(centres: DataFrame, edges: DataFrame, dist: float = 500.0) -> DataFrame:
    """Edges near each centre (session_id, lat0, lon0): radii d, 2d, 5d, 10d, roads for driving before all; the first that has any.

    An edge is as near as its nearest segment. Centres and segments meet in
    cells as high as the largest radius; a centre looks at as many cells to
    either side as that radius spans at its latitude, a segment lies in all
    cells of its box.
    """
    cell = 10 * dist / 111_000
    wide = cell / F.greatest(F.cos(F.radians(F.least(F.abs("lat0") + cell, F.lit(89.0)))), F.lit(0.01))
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    c = centres.where("lat0 is not null and lon0 is not null and not isnan(lat0) and not isnan(lon0)")
    c = c.withColumn("x", F.explode(span(F.col("lon0") - wide, F.col("lon0") + wide))).withColumn("y", F.explode(span(F.col("lat0") - cell, F.col("lat0") + cell)))
    e = edges.dropDuplicates(["edge_id"]).select("edge_id", "highway", "coords", F.posexplode("coords").alias("i", "a")).withColumn("b", F.coalesce(F.get("coords", F.col("i") + 1), "a"))
    e = e.where((F.col("i") == 0) | (F.col("i") + 1 < F.size("coords")))
    for axis, name in (("x", "lon"), ("y", "lat")):
        e = e.withColumn(axis, F.explode(span(F.least(f"a.{name}", f"b.{name}"), F.greatest(f"a.{name}", f"b.{name}"))))
    m = c.join(e, ["x", "y"])
    ends = [latlon_to_enu(F.col(f"{p}.lat"), F.col(f"{p}.lon"), F.col("lat0"), F.col("lon0")) for p in "ab"]
    m = m.withColumn("far", point_segment_m(F.lit(0.0), F.lit(0.0), *ends[0], *ends[1]))
    d = m.groupBy("session_id", "edge_id").agg(F.first("highway").alias("highway"), F.first("coords").alias("coords"), F.min("far").alias("far"))
    level = F.when(F.col("far") <= dist, 0).when(F.col("far") <= 2 * dist, 1).when(F.col("far") <= 5 * dist, 2).when(F.col("far") <= 10 * dist, 3)
    d = d.withColumn("level", level).where("level is not null").withColumn("drives", ~F.coalesce(F.col("highway"), F.lit("")).rlike(NOT_DRIVEN))
    best = d.groupBy("session_id").agg(F.min(F.when(F.col("drives"), F.col("level"))).alias("by_drive"), F.min("level").alias("by_all"))
    got = d.join(best, "session_id").where((F.col("by_drive").isNotNull() & F.col("drives") & (F.col("level") <= F.col("by_drive"))) | (F.col("by_drive").isNull() & (F.col("level") <= F.col("by_all"))))
    return got.select("session_id", "edge_id", "highway", "coords")


def roads_of_sessions(points: DataFrame, edges: DataFrame, centres: DataFrame, dist: float = 500.0) -> DataFrame:
    """The first source with edges for each session: roads for driving in its box, around its centre, main roads in a wide box.

    Later sources are searched only for the sessions that have no edge so far.
    """
    sources = [
        lambda p, c: roads_in_box(p, edges),
        lambda p, c: roads_in_radius(c, edges, dist),
        lambda p, c: roads_in_box(p, edges, 0.01, MAIN_ROADS),
    ]
    found, left = None, None
    for source in sources:
        p, c = (df if left is None else df.join(left, "session_id", "left_semi") for df in (points, centres))
        more = written(source(p, c), "roads")
        found = more if found is None else found.unionByName(more)
        rest = points.select("session_id").union(centres.select("session_id")).distinct() if left is None else left
        left = written(rest.join(more.select("session_id").distinct(), "session_id", "left_anti"), "left")
        if left.isEmpty():
            break
    return found


def road_errors(points: DataFrame, roads: DataFrame, centres: DataFrame, cell_m: float = 50.0) -> DataFrame:
    """points (session_id, method, sample_idx, series, lat, lon) with error_m, the distance to the session's nearest road.

    Segments lie in cells of LEVELS sizes, each four times the one below. A cell
    of points looks around on all of them at once; the nearest segment that it
    meets bounds the distance of all its points, and with it the one level whose
    neighbours hold every segment that could be nearest to any of them. Those
    that can't be are dropped for the cell as a whole, so that a point meets the
    few that are left in one join. Points whose position is NULL, NaN or
    infinite have a NULL error.
    """
    key, cell = ["session_id", "method", "sample_idx", "series"], ["session_id", "cx", "cy"]
    x, y = latlon_to_enu(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    p = points.join(centres, "session_id", "left").select(*key, finite(x).alias("px"), finite(y).alias("py"))
    p = written(p.withColumns({"cx": F.floor(F.col("px") / cell_m), "cy": F.floor(F.col("py") / cell_m)}), "positions")
    line = roads.dropDuplicates(["session_id", "edge_id"]).join(centres, "session_id").select("session_id", geometry_to_enu(F.col("coords"), F.col("lat0"), F.col("lon0")).alias("c"))
    seg = line.select("session_id", F.posexplode("c").alias("i", "s"), F.col("c")).withColumn("e", F.get("c", F.col("i") + 1)).where("e is not null")
    seg = seg.select("session_id", *(finite(F.col(f"{e}.{v}")).alias(n) for e, v, n in (("s", "x", "ax"), ("s", "y", "ay"), ("e", "x", "bx"), ("e", "y", "by"))))
    seg = written(seg.dropna().distinct(), "segments")
    # every segment by the cells that pieces of it, no longer than a cell, lie in
    size = cell_m * F.pow(F.lit(4.0), F.col("level"))
    s = seg.withColumn("level", F.explode(F.array(*(F.lit(k) for k in range(LEVELS)))))
    s = s.withColumn("n", F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / size)).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    for v in "xy":
        ends = [F.floor((F.col(f"a{v}") + (F.col(f"b{v}") - F.col(f"a{v}")) * (F.col("t") + w) / F.col("n")) / size) for w in (0, 1)]
        s = s.withColumn(v, F.explode(F.array_distinct(F.array(*ends))))
    s = written(s.select("session_id", "level", "x", "y", "ax", "ay", "bx", "by").distinct(), "cells")
    at = ["session_id", "level", "x", "y"]
    places = written(p.where("px is not null and py is not null").select(*cell, "px", "py").distinct(), "places")
    q = places.select(*cell).distinct()
    around = lambda level: F.array(*(F.struct(level.alias("level"), (F.floor(F.col("cx") / F.pow(F.lit(4.0), level)) + i).alias("x"), (F.floor(F.col("cy") / F.pow(F.lit(4.0), level)) + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    middle = [(F.col(c) + 0.5) * cell_m for c in ("cx", "cy")]
    far = point_segment_m(*middle, *(F.col(c) for c in ("ax", "ay", "bx", "by")))
    one = s.groupBy(*at).agg(F.min(F.struct("ax", "ay", "bx", "by")).alias("one")).select(*at, "one.*")
    looks = q.withColumn("level", F.explode(F.array(*(F.lit(k) for k in range(LEVELS))))).select(*cell, F.explode(around(F.col("level"))).alias("c")).select(*cell, "c.*")
    # no segment farther from the cell's middle than this is nearest to a point of the cell
    across = cell_m * 2**0.5 + 1e-6
    bound = looks.join(one, at).groupBy(*cell).agg((F.min(far) + across).alias("within"))
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(F.col("within") <= cell_m * 4.0**k, k).otherwise(level)
    asked = bound.withColumn("level", level).select(*cell, "within", F.explode(around(F.col("level"))).alias("c")).select(*cell, "within", "c.*")
    met = asked.join(s, at).withColumn("far", far).where("far <= within").groupBy(*cell).agg(F.collect_set(F.struct("far", "ax", "ay", "bx", "by")).alias("near"))
    least = F.array_min(F.transform("near", lambda r: r["far"]))
    met = met.select(*cell, "near", least.alias("least")).select(*cell, F.filter("near", lambda r: r["far"] <= F.col("least") + across).alias("near"))
    error = F.array_min(F.transform("near", lambda r: point_segment_m(F.col("px"), F.col("py"), r["ax"], r["ay"], r["bx"], r["by"])))
    errors = places.join(met, cell).select("session_id", "px", "py", error.alias("error_m"))
    return p.join(errors, ["session_id", "px", "py"], "left").select(*key, "error_m")


def errors_side_by_side(points: DataFrame, errors: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """session_id, method, sample_idx, (timestamp), lat_raw, lon_raw, lat_smooth, lon_smooth, dist_error_raw_m, dist_error_smooth_m.

    errors: of both series, as `road_errors` gives them; times: session_id,
    sample_idx, timestamp.
    """
    raw = errors.where("series = 'raw'").groupBy("session_id", "sample_idx").agg(F.first("error_m").alias("dist_error_raw_m"))
    smooth = errors.where("series = 'smooth'").select("session_id", "method", "sample_idx", F.col("error_m").alias("dist_error_smooth_m"))
    rows = points.join(raw, ["session_id", "sample_idx"], "left").join(smooth, ["session_id", "method", "sample_idx"], "left")
    columns = ["lat_raw", "lon_raw", "lat_smooth", "lon_smooth", "dist_error_raw_m", "dist_error_smooth_m"]
    if times is None:
        return rows.select("session_id", "method", "sample_idx", *columns)
    return rows.join(times.select("session_id", "sample_idx", "timestamp"), ["session_id", "sample_idx"], "left").select("session_id", "method", "sample_idx", "timestamp", *columns)


QUANTILES = {"p50_m": 0.5, "p75_m": 0.75, "p90_m": 0.9, "p95_m": 0.95, "p99_m": 0.99}


def accuracy(errors: DataFrame, by: Sequence[str] = ("session_id", "method", "series"), percentiles: str = "buffered") -> DataFrame:
    """Twelve error metrics of each group; percentiles are linear.

    percentiles: 'buffered' are exact and hold a group's distinct values in one
    task, which suits groups within a session; 'refined' are exact for groups of
    any size, in several passes; 'approximate' take one pass.
    """
    if percentiles not in ("buffered", "refined", "approximate"):
        raise ValueError(f"unknown percentiles {percentiles!r}")
    e = finite(F.col("error_m"))
    if percentiles == "refined":
        errors = written(errors.select(*by, "error_m"), "errors")
        a = errors.groupBy(*by).agg(F.count(e).alias("n_points"), F.avg(e).alias("mean_m"), F.sqrt(F.avg(e * e)).alias("rms_m"), F.stddev_samp(e).alias("std_m"), F.max(e).alias("max_m"), F.min(e).alias("min_m"))
        return a.join(exact_quantiles(errors, by, "error_m", QUANTILES), list(by), "left").withColumn("median_m", F.col("p50_m")).select(*by, *METRICS)
    q = (F.percentile if percentiles == "buffered" else F.percentile_approx)(e, F.array(*map(F.lit, QUANTILES.values())))
    a = errors.groupBy(*by).agg(F.count(e).alias("n_points"), F.avg(e).alias("mean_m"), F.sqrt(F.avg(e * e)).alias("rms_m"), F.stddev_samp(e).alias("std_m"), q.alias("q"), F.max(e).alias("max_m"), F.min(e).alias("min_m"))
    names = {n: i for i, n in enumerate(QUANTILES)}
    return a.withColumns({"median_m": F.get("q", F.lit(0)), **{n: F.get("q", F.lit(i)) for n, i in names.items()}}).select(*by, *METRICS)


def error_histogram(errors: DataFrame, bins: int = 39, limit: float = 20.0) -> DataFrame:
    """session_id, method, series, bin, n, density: raw errors beside those of each method, in the same bins.

    Bins reach from 0 to the smallest of the largest raw error, the largest
    smoothed one and `limit`; the last bin is closed.
    """
    raw, smooth = errors.where("series = 'raw'"), errors.where("series = 'smooth'")
    tops = smooth.groupBy("session_id", "method").agg(F.max("error_m").alias("top"))
    tops = tops.join(raw.groupBy("session_id").agg(F.max("error_m").alias("raw_top")), "session_id")
    tops = tops.select("session_id", "method", F.least("top", "raw_top", F.lit(limit)).alias("top")).where("top > 0")
    sides = raw.drop("method").join(tops, "session_id").select("session_id", "method", "series", "error_m", "top")
    sides = sides.unionByName(smooth.join(tops, ["session_id", "method"]).select("session_id", "method", "series", "error_m", "top"))
    e = sides.where("error_m between 0 and top").withColumn("bin", F.least(F.floor(F.col("error_m") * bins / F.col("top")).cast("int"), F.lit(bins - 1)))
    n = F.sum("n").over(Window.partitionBy("session_id", "method", "series"))
    counts = e.groupBy("session_id", "method", "series", "bin", "top").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / (n * F.col("top") / bins)).drop("top")


def box_plot(errors: DataFrame) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    by = ["session_id", "method", "series"]
    q = errors.groupBy(by).agg(F.percentile("error_m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*by, *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    e = errors.join(q, by).withColumn("reach", 1.5 * (F.col("q3") - F.col("q1")))
    inside = F.when((F.col("error_m") >= F.col("q1") - F.col("reach")) & (F.col("error_m") <= F.col("q3") + F.col("reach")), F.col("error_m"))
    return e.groupBy(*by, "q1", "median", "q3").agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))


def track_distance(points: DataFrame, centres: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distance along the smoothed track as the running sum of planar steps."""
    x, y = latlon_to_enu(F.col("lat_smooth"), F.col("lon_smooth"), F.col("lat0"), F.col("lon0"))
    p = in_chunks(points.join(centres, "session_id").withColumns({"x": x, "y": y}), chunk, before=1)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(chunk_window()), 2) + F.pow(F.col("y") - F.lag("y").over(chunk_window()), 2))
    return own_rows(add_running_sums(p.withColumn("step", step), {"track_m": F.col("step")})).select("session_id", "sample_idx", "x", "y", "track_m")


def lap_markers(points: DataFrame, laps: DataFrame, centres: DataFrame) -> DataFrame:
    """The two end samples of each lap in local metres; those without a position are left out."""
    x, y = latlon_to_enu(F.col("lat_smooth"), F.col("lon_smooth"), F.col("lat0"), F.col("lon0"))
    at = points.join(centres, "session_id").select("session_id", "sample_idx", x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    out = None
    for end in ("start", "end"):
        m = laps.select("session_id", "lap_number", F.col(f"{end}_sample_idx").alias("sample_idx"), F.lit(end).alias("marker")).join(at, ["session_id", "sample_idx"])
        out = m if out is None else out.unionByName(m)
    return out


def summary_table(metrics: DataFrame) -> DataFrame:
    """Long form: metric, Raw_GPS, Smoothed_GPS of each session and method; without the doubled median."""
    names = [m for m in METRICS if m != "p50_m"]
    long = metrics.select("session_id", "method", "series", *(F.col(m).cast("double") for m in names)).unpivot(["session_id", "method", "series"], names, "Metric", "value")
    one = lambda s: F.max(F.when(F.col("series") == s, F.col("value")))
    return long.groupBy("session_id", "method", "Metric").agg(one("raw").alias("Raw_GPS"), one("smooth").alias("Smoothed_GPS"))


def method_points(series: DataFrame, methods: Sequence[str] = ("gaussian", "savgol", "ma"), window: int = 7, chunk: int = CHUNK) -> DataFrame:
    """lat_raw, lon_raw, lat_smooth, lon_smooth of each method, in one pass over the sessions."""
    before, after = (max(x) for x in zip(*(reach(m, window) for m in methods), strict=True))
    s = positions_in_chunks(series, chunk, before, after)
    for m in methods:
        s = with_smoothed(s, m, window, f"lat_{m}", f"lon_{m}")
    s = own_rows(s)
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"lat_{m}").alias("lat_smooth"), F.col(f"lon_{m}").alias("lon_smooth")) for m in methods))
    return s.select("session_id", "sample_idx", F.col("lat").alias("lat_raw"), F.col("lon").alias("lon_raw"), F.explode(each).alias("m")).select("session_id", "sample_idx", "lat_raw", "lon_raw", "m.*")


def both_series(points: DataFrame) -> DataFrame:
    """Raw (once a session) and smoothed positions as rows for `road_errors`."""
    smooth = points.select("session_id", "method", "sample_idx", F.lit("smooth").alias("series"), F.col("lat_smooth").alias("lat"), F.col("lon_smooth").alias("lon"))
    first = points.groupBy("session_id").agg(F.min("method").alias("method"))
    raw = points.join(first, ["session_id", "method"]).select("session_id", F.lit("raw").alias("method"), "sample_idx", F.lit("raw").alias("series"), F.col("lat_raw").alias("lat"), F.col("lon_raw").alias("lon"))
    return smooth.unionByName(raw)


def best_methods(metrics: DataFrame, methods: Sequence[str] = ("gaussian", "savgol", "ma")) -> DataFrame:
    """For each session and metric the method with the lowest value; the first in order wins ties."""
    rank = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    long = metrics.where("series = 'smooth'").select("session_id", "method", *COMPARED).unpivot(["session_id", "method"], COMPARED, "metric", "value")
    long = long.where("value is not null and not isnan(value)")
    return long.groupBy("session_id", "metric").agg(F.min_by("method", F.struct("value", rank.alias("r"))).alias("method"), F.min("value").alias("value"))


def comparison_table(metrics: DataFrame) -> DataFrame:
    """Wide: one row for each session and method, metric columns in order of name."""
    return metrics.where("series = 'smooth'").select("session_id", F.col("method").alias("Method"), *sorted(METRICS))


def missing_results(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """The (session_id, method) of wanted that have no stored result."""
    return wanted.join(existing.select("session_id", "method").distinct(), ["session_id", "method"], "left_anti")

"""Map layers: lines, coloured laps, speed legend and heat maps.

Samples without a position are left out of lines, not of a session's largest
values. A NULL speed counts as 0, a NULL acceleration as none. Empty tables give
empty results; columns of telemetry named like a result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from .laps import lap_samples

#: Colours of the speed scale at 0, 20, 40, 60 and 80 per cent, and of laps by position.
STOPS = [(0.0, 0, 136, 255), (0.2, 0, 255, 0), (0.4, 255, 255, 0), (0.6, 255, 136, 0), (0.8, 255, 0, 0)]
PALETTE = ["#ff2d55", "#00ffa3", "#ffd60a", "#28a2ff", "#b28dff", "#ff8a5b"]


def speed_scale(telemetry: DataFrame) -> DataFrame:
    """session_id, scale_mph: the largest speed up to the next ten, ten at least."""
    return telemetry.groupBy("session_id").agg(F.greatest(F.lit(10.0), F.ceil(F.coalesce(F.max("speed_mph"), F.lit(0.0)) / 10) * 10.0).alias("scale_mph"))


def speed_band_color(mph: Column, scale: Column) -> Column:
    """Colour as #rrggbb: linear between the stops, clamped."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(mph, F.lit(0.0)) / scale))
    last = STOPS[-1]
    parts = [F.lit(x) for x in last[1:]]
    for (r0, *c0), (r1, *c1) in reversed(list(zip(STOPS, STOPS[1:], strict=False))):
        parts = [F.when(ratio < r1, F.floor(F.lit(float(x)) + (y - x) * (ratio - r0) / (r1 - r0)).cast("int")).otherwise(p) for x, y, p in zip(c0, c1, parts, strict=True)]
    return F.format_string("#%02x%02x%02x", *parts)


def speed_legend(telemetry: DataFrame) -> DataFrame:
    """Five bands of each session: colour, low_mph, high_mph."""
    b = speed_scale(telemetry).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return b.select("session_id", "band", speed_band_color(F.col("scale_mph") * F.col("band") / 5, F.col("scale_mph")).alias("color"), (F.col("scale_mph") * F.col("band") / 5).alias("low_mph"), (F.col("scale_mph") * (F.col("band") + 1) / 5).alias("high_mph"))


def track_geojson(telemetry: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """session_id, geojson, error: the track as a line and its start (session_id, start_lat, start_lon, else its first point) as a point.

    Sessions without positions have an error instead.
    """
    valid = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("sample_idx", F.array("lon", "lat").alias("p")))
    line = telemetry.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(valid)), lambda x: x["p"]).alias("line"))
    line = line.withColumns({"start": F.get("line", F.lit(0)), "n": F.size("line")})
    if starts is not None:
        given = starts.where("start_lat is not null and start_lon is not null").groupBy("session_id").agg(F.first(F.array("start_lon", "start_lat")).alias("given"))
        line = line.join(given, "session_id", "left").withColumn("start", F.coalesce("given", "start"))
    track = _feature("LineString", F.col("line"), F.struct(F.col("n").alias("sampleCount")))
    marker = _feature("Point", F.col("start"), F.struct(F.lit("start_finish").alias("marker")))
    found = F.col("n") > 0
    return line.select("session_id", F.when(found, _collection(F.concat_ws(",", track, marker))).alias("geojson"), F.when(~found, F.lit("no valid coordinates")).alias("error"))


def track_pieces(telemetry: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """session_id, sample_idx, piece: in order of sample_idx, the text of `track_geojson` with one piece for each point, one before and one behind them.

    No row grows with the session. Sessions without positions have no piece.
    """
    valid = telemetry.where("lat is not null and lon is not null").select("session_id", F.col("sample_idx").cast("long").alias("sample_idx"), F.array("lon", "lat").alias("p"))
    ends = valid.groupBy("session_id").agg(F.min("sample_idx").alias("first_idx"), F.max("sample_idx").alias("last_idx"), F.count(F.lit(1)).cast("int").alias("n"), F.min_by("p", "sample_idx").alias("start"))
    if starts is not None:
        given = starts.where("start_lat is not null and start_lon is not null").groupBy("session_id").agg(F.first(F.array("start_lon", "start_lat")).alias("given"))
        ends = ends.join(given, "session_id", "left").withColumn("start", F.coalesce("given", "start"))
    points = valid.join(ends.select("session_id", "first_idx"), "session_id").select("session_id", "sample_idx", F.concat(F.when(F.col("sample_idx") > F.col("first_idx"), ",").otherwise(""), F.to_json("p")).alias("piece"))
    # the feature of an empty line, cut where its points belong
    track = _collection(F.concat_ws(",", _feature("LineString", F.array().cast("array<array<double>>"), F.struct(F.col("n").alias("sampleCount"))), _feature("Point", F.col("start"), F.struct(F.lit("start_finish").alias("marker")))))
    cut = F.locate('"coordinates":[', track) + len('"coordinates":[') - 1
    around = ends.select("session_id", F.explode(F.array(F.struct((F.col("first_idx") - 1).alias("sample_idx"), F.substring(track, F.lit(1), cut).alias("piece")), F.struct((F.col("last_idx") + 1).alias("sample_idx"), F.substring(track, cut + 1, F.length(track)).alias("piece")))).alias("x")).select("session_id", "x.*")
    return points.unionByName(around)


def lap_pieces(features: DataFrame) -> DataFrame:
    """session_id, is_partial, start_sample_idx, piece: the text of `lap_collections` with one piece for each lap, one before and one behind them."""
    key = ["session_id", "is_partial"]
    f = features.select(*key, F.col("start_sample_idx").cast("long").alias("start_sample_idx"), "feature")
    ends = f.groupBy(*key).agg(F.min("start_sample_idx").alias("a"), F.max("start_sample_idx").alias("b"))
    each = f.join(ends, key).select(*key, "start_sample_idx", F.concat(F.when(F.col("start_sample_idx") > F.col("a"), ",").otherwise(""), "feature").alias("piece"))
    piece = lambda at, text: F.struct(at.alias("start_sample_idx"), F.lit(text).alias("piece"))
    around = ends.select(*key, F.explode(F.array(piece(F.col("a") - 1, '{"type":"FeatureCollection","features":['), piece(F.col("b") + 1, "]}"))).alias("x")).select(*key, "x.*")
    return each.unionByName(around)


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    """A GeoJSON feature as text."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def _collection(features: Column) -> Column:
    """A GeoJSON collection of features that are text with commas between."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), features, F.lit("]}"))


def lap_segments(telemetry: DataFrame, laps: DataFrame) -> DataFrame:
    """Pairs of neighbouring valid samples of each lap with the colour of the second's speed, and the lap's own colour."""
    place = F.row_number().over(Window.partitionBy("session_id", "is_partial").orderBy("start_sample_idx")) - 1
    palette = F.array(*map(F.lit, PALETTE))
    order = laps.withColumn("lap_color", F.get(palette, place % len(PALETTE))).select("session_id", "start_sample_idx", "is_partial", "lap_color")
    s = lap_samples(telemetry, laps).where("lat is not null and lon is not null").join(order, ["session_id", "start_sample_idx"]).join(speed_scale(telemetry), "session_id")
    lap = Window.partitionBy("session_id", "start_sample_idx").orderBy("sample_idx")
    s = s.withColumns({"from_lat": F.lag("lat").over(lap), "from_lon": F.lag("lon").over(lap)}).where("from_lat is not null")
    return s.select("session_id", "lap_number", "is_partial", "start_sample_idx", "sample_idx", "from_lat", "from_lon", "lat", "lon", F.when(~F.col("is_partial"), speed_band_color(F.col("speed_mph"), F.col("scale_mph"))).alias("color"), "lap_color")


def lap_features(telemetry: DataFrame, laps: DataFrame) -> DataFrame:
    """One row for each lap of two valid samples at least, with its GeoJSON feature.

    session_id, lap_number, is_partial, start_sample_idx, lap_time_s,
    coordinates, segments, segment_colors, stroke, stroke_width, feature. Partial
    laps have coordinates alone.
    """
    s = lap_segments(telemetry, laps)
    pair = F.struct("sample_idx", F.array("from_lon", "from_lat").alias("a"), F.array("lon", "lat").alias("b"), "color")
    by = ["session_id", "lap_number", "is_partial", "start_sample_idx"]
    f = s.groupBy(*by, "lap_color").agg(F.sort_array(F.collect_list(pair)).alias("pairs")).join(laps.select(*by, "lap_time_s"), by)
    full = ~F.col("is_partial")
    each = lambda take: F.transform("pairs", take)
    f = f.select(*by, "lap_time_s", F.concat(F.array(F.get("pairs", F.lit(0))["a"]), each(lambda x: x["b"])).alias("coordinates"), F.when(full, each(lambda x: F.array(x["a"], x["b"]))).alias("segments"), F.when(full, each(lambda x: x["color"])).alias("segment_colors"), F.when(full, F.col("lap_color")).alias("stroke"), F.when(full, F.lit(5)).alias("stroke_width"))
    properties = F.struct("lap_number", "lap_time_s", "segments", "segment_colors", "stroke", "stroke_width", F.when(~full, F.lit(True)).alias("is_partial"))
    return f.withColumn("feature", _feature("LineString", F.col("coordinates"), properties))


def lap_collections(features: DataFrame) -> DataFrame:
    """session_id, is_partial, geojson: the features of a session's full and of its partial laps, in order."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("start_sample_idx", "feature"))), lambda x: x["feature"])
    return features.groupBy("session_id", "is_partial").agg(_collection(F.array_join(each, ",")).alias("geojson"))


def heatmap_layers(telemetry: DataFrame) -> DataFrame:
    """session_id, layer, sample_idx, lat, lon, intensity, value: braking, throttle and lateral acceleration."""
    brake, throttle = F.greatest(-F.col("long_accel_mps2"), F.lit(0.0)), F.greatest(F.col("long_accel_mps2"), F.lit(0.0))
    sides = (("brake", brake), ("throttle", throttle), ("lateral", F.col("lat_accel_mps2")))
    tops = telemetry.groupBy("session_id").agg(*(F.max(F.abs(v)).alias(f"top_{n}") for n, v in sides))
    each = F.array(*(F.struct(F.lit(n).alias("layer"), v.alias("value"), F.col(f"top_{n}").alias("most")) for n, v in sides))
    t = telemetry.where("lat is not null and lon is not null").join(tops, "session_id").select("session_id", "sample_idx", "lat", "lon", F.explode(each).alias("v"))
    t = t.where("v.value != 0 and v.most > 0")
    return t.select("session_id", "v.layer", "sample_idx", "lat", "lon", half_up(F.least(F.lit(1.0), F.abs("v.value") / F.col("v.most")), 3).alias("intensity"), half_up(F.col("v.value"), 3).alias("value"))

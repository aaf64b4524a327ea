"""The sample nearest to a point, by cells of many sizes.

The finest cells split the circle of longitudes FINE times, those of each level
above are four times as wide, and the top level is one cell. A point looks at
the cells around it on all levels at once; the nearest sample that stands for
one of these bounds its distance, and with it the level whose neighbours hold
every sample that could be nearer. There the point meets the finest cells that
have samples, drops those that lie beyond the best one, and only then samples.
Each is one join on equal keys; nothing is repeated until it fits. Samples of
one place, and points of one place, go through it once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import SPHERE_M, haversine_m
from ..functions.numbers import half_up
from ..sources.staging import written

#: Powers of two: cells round the circle at the finest level, and how much wider a level is than the one below.
FINE, WIDER = 22, 2
TOP = FINE // WIDER
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
#: Metres by which bounds are widened, for rounding.
SLACK_M = 1e-3


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) <= 360.0)


def _grid(degrees: Column) -> Column:
    return F.floor(degrees * (2.0**FINE / 360.0))


def _turn(lon: Column) -> Column:
    """Longitude from 0 to 360."""
    return F.pmod(lon + 180.0, F.lit(360.0))


def _cells(level: Column) -> Column:
    """The nine cells around (cx, cy) at a level, each once; longitude wraps."""
    by = F.pow(F.lit(2.0), level * WIDER)
    wide = F.pow(F.lit(2.0), FINE - level * WIDER)
    x, y = F.floor(F.col("cx") / by), F.floor(F.col("cy") / by)
    return F.array_distinct(F.array(*(F.struct(level.alias("level"), F.pmod(x + i, wide).cast("long").alias("x"), (y + j).alias("y")) for i, j in AROUND)))


def _gap_m(lat: Column, lon: Column) -> Column:
    """At most the metres from a point to a box of lat_lo, lat_hi, lon_lo, lon_hi."""
    up = F.greatest(F.lit(0.0), F.col("lat_lo") - lat, lat - F.col("lat_hi"))
    inside = (lon >= F.col("lon_lo")) & (lon <= F.col("lon_hi"))
    aside = F.when(inside, 0.0).otherwise(F.least(F.pmod(F.col("lon_lo") - lon, F.lit(360.0)), F.pmod(lon - F.col("lon_hi"), F.lit(360.0)), F.lit(90.0)))
    return SPHERE_M * F.greatest(F.radians(up), F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(aside))))


def nearest_samples(points: DataFrame, samples: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Each point (by.., point_id, lat, lon) with the nearest sample_idx of its key and its distance; the first wins ties (to a micrometre).

    With by = (session_id, lap_number) the search is confined to a lap. Points
    or samples whose position is NULL, NaN or beyond the globe are left out, as
    are points whose key has no sample; a repeated point is one. Extra columns
    are ignored.
    """
    by, point, spot = list(by), [*by, "point_id"], [*by, "lat", "lon"]
    q = points.where(_finite("lat") & _finite("lon")).select(*point, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    q = written(q.dropDuplicates(point), "points")
    # of samples at one place only the first can be the answer, and points at one place have the same answer
    s = samples.where(_finite("lat") & _finite("lon")).groupBy(*by, F.col("lat").alias("slat"), F.col("lon").alias("slon")).agg(F.min("sample_idx").alias("idx"))
    s = written(s.withColumns({"cx": _grid(_turn(F.col("slon"))), "cy": _grid(F.col("slat") + 90.0)}), "places")
    box = {"lat_lo": F.min("slat"), "lat_hi": F.max("slat"), "lon_lo": F.min(_turn(F.col("slon"))), "lon_hi": F.max(_turn(F.col("slon")))}
    fine = written(s.groupBy(*by, "cx", "cy").agg(F.min(F.struct("idx", "slat", "slon")).alias("one"), *(v.alias(k) for k, v in box.items())), "cells")
    each = F.explode(F.array(*(F.lit(k) for k in range(TOP + 1)))).alias("level")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level") * WIDER))
    known = fine.select("*", each).withColumns({"x": at("cx"), "y": at("cy")})
    key = [*by, "level", "x", "y"]
    spots = q.select(*spot).distinct().withColumns({"cx": _grid(_turn(F.col("lon"))), "cy": _grid(F.col("lat") + 90.0)})
    # how near a sample is for certain
    around = spots.select("*", each).select(*spot, "cx", "cy", F.explode(_cells(F.col("level"))).alias("c")).select(*spot, "cx", "cy", "c.*")
    stands = known.groupBy(*key).agg(F.min("one").alias("one"))
    bound = around.join(stands, key).groupBy(*spot, "cx", "cy").agg(F.min(haversine_m(F.col("lat"), F.col("lon"), F.col("one.slat"), F.col("one.slon"))).alias("within"))
    # the first level whose neighbouring cells reach that far in both directions
    reach = F.lit(None).cast("int")
    for k in reversed(range(TOP)):
        size = 360.0 / 2 ** (FINE - WIDER * k)
        north, east = SPHERE_M * math.radians(size), SPHERE_M * F.asin(F.cos(F.radians("lat")) * math.sin(math.radians(min(size, 90.0))))
        reach = F.when((F.col("within") + SLACK_M <= north) & (F.col("within") + SLACK_M <= east), k).otherwise(reach)
    asked = bound.withColumn("level", F.coalesce(reach, F.lit(TOP))).select(*spot, "within", F.explode(_cells(F.col("level"))).alias("c")).select(*spot, "within", "c.*")
    metres = haversine_m(F.col("lat"), F.col("lon"), F.col("one.slat"), F.col("one.slon"))
    near = asked.join(known, key).withColumn("gap", _gap_m(F.col("lat"), _turn(F.col("lon")))).where(F.col("gap") <= F.col("within") + SLACK_M)
    near = near.withColumn("best", F.min(metres).over(Window.partitionBy(*spot))).where(F.col("gap") <= F.col("best") + SLACK_M).select(*spot, "cx", "cy")
    d = half_up(haversine_m(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")), 6)
    found = near.join(s, [*by, "cx", "cy"]).groupBy(*spot).agg(F.min(F.struct(d.alias("d"), "idx")).alias("n"))
    return q.join(found, spot).select(*point, F.col("n.idx").alias("sample_idx"), F.col("n.d").alias("distance_m"))

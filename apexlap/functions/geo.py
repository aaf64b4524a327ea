"""Distances and local planes as column arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius, ellipsoid axis and first eccentricity squared.
SPHERE_M, AXIS_M, ECC2 = 6371000.0, 6378137.0, 6.69437999014e-3


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; NULL where a coordinate is NULL."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * SPHERE_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def latlon_to_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin on a sphere of the equator's radius."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * AXIS_M, F.radians(lat - lat0) * AXIS_M


def latlon_to_enu(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north with the ellipsoid's radius at the origin for both axes."""
    n = AXIS_M / F.sqrt(1 - ECC2 * F.pow(F.sin(F.radians(lat0)), 2))
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * n, F.radians(lat - lat0) * n


def geometry_to_enu(coords: Column, lat0: Column, lon0: Column) -> Column:
    """An array of (lon, lat) points as (x, y) metres."""
    return F.transform(coords, lambda p: F.struct(*(c.alias(n) for c, n in zip(latlon_to_enu(p["lat"], p["lon"], lat0, lon0), "xy", strict=True))))


def point_segment_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))

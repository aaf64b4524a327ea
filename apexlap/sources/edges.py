"""Road edges from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COORDS = "array<struct<lon:double,lat:double>>"
FORMATS = ("parquet", "json", "geojson")


def read_road_edges(spark: SparkSession, path: str, form: str = "parquet", only: str | None = None) -> DataFrame:
    """edge_id, highway, coords: from a table, lines of JSON of the same columns, or lines of one GeoJSON feature each.

    A feature's properties give edge_id and highway; each line of a
    MultiLineString is an edge of its own, with the same id and class. only: a
    pattern that the class must match anywhere. Features without a line, lines
    that are no JSON and edges without a point are left out; a NULL id or class
    stays. Other columns are ignored.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; choose from {', '.join(FORMATS)}")
    if form == "geojson":
        text = spark.read.text(path)
        feature = F.from_json("value", "properties struct<edge_id:bigint,highway:string>, geometry struct<type:string,coordinates:string>").alias("f")
        f = text.select(feature).select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("raw"))
        line, lines = F.from_json("raw", "array<array<double>>"), F.from_json("raw", "array<array<array<double>>>")
        every = F.when(F.col("kind") == "LineString", F.array(line)).when(F.col("kind") == "MultiLineString", lines)
        edges = f.select("edge_id", "highway", F.explode(every).alias("line"))
        edges = edges.select("edge_id", "highway", F.transform("line", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))).cast(COORDS).alias("coords"))
    else:
        edges = spark.read.schema(f"edge_id bigint, highway string, coords {COORDS}").format(form).load(path)
    if only:
        edges = edges.where(F.col("highway").rlike(only))
    return edges.where(F.size("coords") > 0)

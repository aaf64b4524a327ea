"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.laps import lap_samples
from .staging import written

#: The columns of an exported lap, in order.
LAP_COLUMNS = ["timestamp", "lap_number", "lap_elapsed_s", "lap_distance_m", "lat", "lon", "speed_mph", "long_accel_mps2", "lat_accel_mps2", "imu_accel_x", "imu_accel_y", "imu_accel_z"]
#: Rows of a result that share a part of a document.
PART_ROWS = 1024
#: Laps of a session that share a folder of the export.
LAPS_A_FOLDER = 1000


def lap_rows(annotated: DataFrame, laps: DataFrame) -> DataFrame:
    """The exported columns of every full lap's samples, both ends included."""
    return lap_samples(annotated, laps.where("not is_partial")).select("session_id", "sample_idx", *LAP_COLUMNS)


def export_lap_csv(annotated: DataFrame, laps: DataFrame, path: str, lap_number: int | None = None) -> None:
    """CSV files by session and run of LAPS_A_FOLDER laps (`laps_from`: the first), in order of lap and sample; an unknown lap is a ValueError.

    The lap is a column of the files, as a folder for each lap would make as
    many files as laps.
    """
    rows = lap_rows(annotated, laps)
    if lap_number is not None:
        rows = rows.where(F.col("lap_number") == lap_number)
        if rows.isEmpty():
            raise ValueError(f"no lap {lap_number}")
    rows = rows.withColumn("laps_from", F.col("lap_number") - (F.col("lap_number") - 1) % LAPS_A_FOLDER)
    rows.repartition("session_id", "laps_from").sortWithinPartitions("session_id", "laps_from", "lap_number", "sample_idx").select("session_id", "laps_from", *LAP_COLUMNS).write.partitionBy("session_id", "laps_from").csv(path, header=True)


def document_parts(results: dict[str, DataFrame], size: int = PART_ROWS) -> DataFrame:
    """session_id, at, result, first, n, text: the JSON document of each session in parts.

    A session's texts in order of `at` are one JSON object with a field for each
    result. A result's rows are an array in order of lap, corner and sample; a
    part has up to `size` of them, or of numbers of the last of these columns.
    A result with a column `geojson` is one row and one part; one with a column
    `piece` is the text of its pieces in that order. first: how many rows of
    the result come before the part's n.
    """
    order = ["is_partial", "layer", "lap_number", "start_sample_idx", "corner_id", "sample_idx"]
    parts, kinds, last = None, [], len(results) - 1
    for no, df in enumerate(results.values()):
        own = [c for c in order if c in df.columns and "geojson" not in df.columns]
        kinds.append("geojson" if "geojson" in df.columns else "piece" if "piece" in df.columns else "rows")
        at = {c: F.coalesce(F.col(c).cast("string" if c == "layer" else "long"), F.lit("" if c == "layer" else -1)) if c in own else F.lit("" if c == "layer" else -1).cast("string" if c == "layer" else "long") for c in order}
        run = at | ({own[-1]: F.floor(at[own[-1]] / size)} if own and own[-1] != "layer" else {})
        row = F.to_json(F.struct(*(c for c in df.columns if c != "session_id"))) if kinds[-1] == "rows" else F.col(kinds[-1])
        each = df.select("session_id", F.struct(*(v.alias(c) for c, v in run.items())).alias("run"), F.struct(*(v.alias(c) for c, v in at.items())).alias("by"), row.alias("row")).where("row is not null")
        if kinds[-1] == "geojson":
            each = each.groupBy("session_id", "run", "by").agg(F.first("row").alias("row"))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("by", "row"))), lambda x: x["row"]), "," if kinds[-1] == "rows" else "")
        part = each.groupBy("session_id", "run").agg(F.count(F.lit(1)).alias("n"), joined.alias("text")).select("session_id", F.lit(no).alias("no"), "run", "n", "text")
        part = part.unionByName(df.select("session_id", F.lit(no).alias("no"), F.lit(None).cast(part.schema["run"].dataType).alias("run"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("text")).dropDuplicates(["session_id"]))
        parts = part if parts is None else parts.unionByName(part)
    parts = written(parts, "parts")
    rows = parts.where("run is not null")
    before = Window.partitionBy("session_id", "no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.select("session_id", "no", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    pick = lambda of: F.array(*(F.lit(of(k)) for k in range(len(kinds))))[F.col("no")]
    names = list(results)
    comma = F.when((F.col("first") > 0) & (pick(lambda k: kinds[k]) == "rows"), ",").otherwise("")
    body = rows.join(first, ["session_id", "no", "run"]).select("session_id", "no", F.lit(1).alias("stage"), "run", "first", "n", F.concat(comma, "text").alias("text"))
    some = parts.groupBy("session_id", "no").agg(F.sum("n").alias("some"))
    all_ = parts.select("session_id").distinct().withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(last))))
    frame = all_.join(some, ["session_id", "no"], "left").withColumn("none", F.coalesce("some", F.lit(0)) == 0)
    session = F.when(F.col("no") == 0, F.regexp_replace(F.to_json(F.struct("session_id")), r"\}$", "")).otherwise("")
    head = F.concat(session, pick(lambda k: f',"{names[k]}":'), F.when(pick(lambda k: kinds[k]) == "rows", "[").when(F.col("none"), "null").otherwise(""))
    tail = F.concat(F.when(pick(lambda k: kinds[k]) == "rows", "]").otherwise(""), F.when(F.col("no") == last, "}").otherwise(""))
    for stage, text in ((0, head), (2, tail)):
        body = body.unionByName(frame.select("session_id", "no", F.lit(stage).alias("stage"), F.lit(None).cast(parts.schema["run"].dataType).alias("run"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n"), text.alias("text")))
    return body.select("session_id", F.struct("no", "stage", "run").alias("at"), pick(lambda k: names[k]).alias("result"), "first", "n", "text")


def session_documents(results: dict[str, DataFrame]) -> DataFrame:
    """session_id, document: the texts of `document_parts` as one, for sessions whose document fits a row."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return document_parts(results).groupBy("session_id").agg(F.array_join(texts, "").alias("document"))


def export_sessions_json(results: dict[str, DataFrame], path: str) -> None:
    """The documents as text by session: the lines of a session's files, in order of name, are one JSON object."""
    parts = document_parts(results).repartitionByRange("session_id", "at").sortWithinPartitions("session_id", "at")
    parts.select("session_id", F.col("text").alias("value")).write.partitionBy("session_id").text(path)


def export_comparison_csv(comparison: DataFrame, path: str) -> None:
    """Method and its metrics in order of name, by session."""
    comparison.write.partitionBy("session_id").csv(path, header=True)


def export_validation_csv(per_sample: DataFrame, path: str) -> None:
    """Raw and smoothed positions with both errors, by session and method."""
    per_sample.write.partitionBy("session_id", "method").csv(path, header=True)


def export_summary_csv(summary: DataFrame, path: str) -> None:
    """Metric, Raw_GPS, Smoothed_GPS by session and method."""
    summary.write.partitionBy("session_id", "method").csv(path, header=True)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Stored summaries: session_id, method, metric and the smoothed value."""
    s = spark.read.csv(path, header=True)
    return s.select("session_id", "method", F.col("Metric").alias("metric"), F.col("Smoothed_GPS").try_cast("double").alias("value"))


def stored(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """One session's rows of a stored result; a table written by session is pruned to its folder."""
    return spark.read.parquet(path).where(F.col("session_id") == session_id)

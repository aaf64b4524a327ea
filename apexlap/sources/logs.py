"""Log files of many sessions as one time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import safe_float


def read_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Record type -> field names in file order; later duplicates win, blank lines are skipped. The file is a few lines."""
    lines = [r.value.strip() for r in spark.read.text(path).select("value").collect()]
    return {p[0]: p[1:] for p in (line.split(",") for line in lines if line)}


def read_log_lines(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """session_id (file name), line_no, line: in file order also when files are split.

    by_folder: sessions are folders `session_id=...` of one file each instead.
    """
    name = F.regexp_extract("_metadata.file_path", "session_id=([^/]*)/", 1) if by_folder else F.col("_metadata.file_name")
    raw = spark.read.text(path).select(name.alias("session_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))
    order = Window.partitionBy("session_id").orderBy("block", "mid")
    return raw.select("session_id", (F.row_number().over(order) - 1).alias("line_no"), "line")


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    """file_name and display_name of the logs in a folder, sorted; the header file is left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("file_name"))
    return files.where("file_name != 'headers.txt'").select("file_name", F.initcap(F.replace(F.regexp_replace("file_name", r"\.txt$", ""), F.lit("_"), F.lit(" "))).alias("display_name")).orderBy("file_name")


def read_track_starts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, lat, lon by position; names trimmed, a trailing `s` of numbers dropped, other rows skipped."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    raw = raw.toDF(*(f"c{i}" for i in range(len(raw.columns))))
    number = lambda c: F.regexp_replace(F.trim(c), "s$", "").try_cast("double")
    return raw.select(F.trim("c0").alias("file_name"), number(F.col("c1")).alias("lat"), number(F.col("c2")).alias("lon")).where("file_name != '' and lat is not null and lon is not null")


def parse_records(lines: DataFrame, headers: dict[str, list[str]], drop_last_field: bool = True, mode: str = "permissive") -> DataFrame:
    """session_id, timestep, record_type, entry_no, line_no, fields.

    A line's type is the first header name that it starts with; others are
    ignored. A step starts at a `Fix` line after a line of another kind. The last
    declared field isn't read unless drop_last_field is off. Missing fields of
    short lines are NULL, or an error if mode is 'failfast'.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")
    w = Window.partitionBy("session_id").orderBy("line_no")
    is_fix = F.col("line").startswith("Fix")
    df = lines.withColumn("fix", is_fix).withColumn("timestep", F.sum((F.col("fix") & ~F.lag("fix", 1, True).over(w)).cast("int")).over(w))
    kind = F.coalesce(*(F.when(F.col("line").startswith(h), F.lit(h)) for h in headers))
    df = df.withColumn("record_type", kind).where("record_type is not null").withColumn("parts", F.split(F.rtrim("line"), ","))
    fields = F.create_map()
    for h, names in reversed(list(headers.items())):
        used = names[:-1] if drop_last_field else names
        values = []
        for j in range(len(used)):
            v = F.get("parts", F.lit(j + 1))
            values.append(F.when(F.size("parts") <= j + 1, F.raise_error(F.concat(F.lit("short line: "), F.col("line")))).otherwise(v) if mode == "failfast" else v)
        made = F.map_from_arrays(F.array(*map(F.lit, used)).cast("array<string>"), F.array(*values).cast("array<string>"))
        fields = F.when(F.col("record_type") == h, made).otherwise(fields.cast("map<string,string>"))
    entry = F.row_number().over(Window.partitionBy("session_id", "timestep", "record_type").orderBy("line_no")) - 1
    return df.select("session_id", "timestep", "record_type", entry.alias("entry_no"), "line_no", fields.alias("fields"))


def _short() -> Column:
    """Whether a record has fewer fields than declared."""
    return F.exists(F.map_values("fields"), lambda v: v.isNull())


def _time() -> Column:
    """Milliseconds of a step: of its first fix, else of its first raw record."""
    text = lambda k, n: F.min_by(F.when(F.col("record_type") == k, F.col("fields")[n]), F.when(F.col("record_type") == k, F.col("line_no")))
    return F.coalesce(F.nullif(text("Fix", "UnixTimeMillis"), F.lit("")), F.nullif(text("Raw", "utcTimeMillis"), F.lit(""))).try_cast("double")


def time_series(records: DataFrame, seen: Observation | None = None) -> DataFrame:
    """One row for each step with a time: means of its fixes, its first accelerometer and gyroscope entries.

    The calibrated sensor wins if a step has one, even with bad values.
    has_accel tells whether any step of the session has such a record. seen
    gets the totals n_records, n_short and n_untimed (steps that are dropped) of
    the pass that reads the series.
    """
    kind, field = F.col("record_type"), lambda n: F.col("fields")[n]
    fix = lambda n: F.avg(F.when(kind == "Fix", safe_float(field(n))))
    def sensor(name: str, unit: str, alias: str) -> list:
        out = []
        for axis in "XYZ":
            first = lambda k, axis=axis: F.min_by(F.when(kind == k, F.struct(safe_float(field(f"{k}{axis}{unit}")).alias("v"))), F.when(kind == k, F.col("line_no")))
            out.append(F.coalesce(first(name), first(f"Uncal{name}"))["v"].alias(f"{alias}_{axis.lower()}"))
        return out

    steps = records.groupBy("session_id", "timestep").agg(_time().alias("timestamp_ms"), fix("LatitudeDegrees").alias("lat"), fix("LongitudeDegrees").alias("lon"), fix("AltitudeMeters").alias("alt"), fix("SpeedMps").alias("speed_mps"), fix("AccuracyMeters").alias("pos_accuracy_m"), *sensor("Accel", "Mps2", "imu_accel"), *sensor("Gyro", "RadPerSec", "imu_gyro"), F.max(kind.isin("Accel", "UncalAccel")).alias("step_accel"), F.count(F.lit(1)).alias("n"), F.sum(_short().cast("long")).alias("short"))
    if seen is not None:
        steps = steps.observe(seen, F.sum("n").alias("n_records"), F.sum("short").alias("n_short"), F.count_if(F.col("timestamp_ms").isNull() | F.isnan("timestamp_ms")).alias("n_untimed"))
    s = steps.drop("n", "short").withColumn("has_accel", F.max("step_accel").over(Window.partitionBy("session_id"))).drop("step_accel").where("timestamp_ms is not null and not isnan(timestamp_ms)")
    order = Window.partitionBy("session_id").orderBy("timestamp_ms", "timestep")
    return s.withColumns({"timestamp": F.timestamp_micros(F.round(F.col("timestamp_ms") * 1000).cast("long")), "sample_idx": F.row_number().over(order) - 1})


def log_quality(lines: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """One row for each session: n_lines, n_unknown, n_short, n_steps, n_untimed, n_placed, has_position.

    n_unknown: lines of no declared type; n_short: records with fewer fields
    than declared; n_untimed: steps that a series drops for lack of a time;
    n_placed: timed steps with a position. Everything comes from one parsing of
    the lines, by time step and then by session.
    """
    records = parse_records(lines, headers)
    kind, field = F.col("record_type"), lambda n: F.col("fields")[n]
    mean = lambda n: F.avg(F.when(kind == "Fix", safe_float(field(n))))
    steps = records.groupBy("session_id", "timestep").agg(F.count(F.lit(1)).alias("n"), F.sum(_short().cast("long")).alias("short"), _time().alias("ms"), mean("LatitudeDegrees").alias("lat"), mean("LongitudeDegrees").alias("lon"))
    timed = F.col("ms").isNotNull() & ~F.isnan("ms")
    by = steps.groupBy("session_id").agg(F.sum("n").alias("n"), F.sum("short").alias("n_short"), F.count(F.lit(1)).alias("n_steps"), F.count_if(~timed).alias("n_untimed"), F.count_if(timed & F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("n_placed"))
    total = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_lines")).join(by, "session_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return total.select("session_id", "n_lines", (F.col("n_lines") - F.coalesce("n", F.lit(0))).alias("n_unknown"), *(count(c) for c in ("n_short", "n_steps", "n_untimed", "n_placed")), (F.coalesce("n_placed", F.lit(0)) > 0).alias("has_position"))

"""Laps: boundaries at the start line, records, sectors, partial laps, annotation.

Samples without a position are never boundaries; sessions without any position
are one lap, and a session of one sample has none. Laps of equal time keep their order of start. Repeated starts of a
file count once. Empty tables give empty results. Columns of telemetry that are
named like a result's are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.numbers import half_up
from .chunks import CHUNK, add_last, add_running_sums, in_chunks, own_rows

#: Sessions whose name holds one of these are routes without laps.
ROUTES = ("jackson", "freeway")
#: Files (lower case) with a wide start line, their tolerance in metres and samples to skip.
WIDE, WIDE_M, WIDE_SKIP = ("wintergreen laps.txt", "cheswick laps.txt"), 9.0, 10


def start_points(telemetry: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """session_id, start_lat, start_lon: from the table by exact name, else the first sample with a position."""
    own = telemetry.where("lat is not null and lon is not null").groupBy("session_id").agg(F.min_by(F.struct("lat", "lon"), "sample_idx").alias("p"))
    if starts is None:
        return own.select("session_id", F.col("p.lat").alias("start_lat"), F.col("p.lon").alias("start_lon"))
    known = starts.groupBy("file_name").agg(F.first(F.struct("lat", "lon")).alias("q"))
    both = own.join(known, own.session_id == known.file_name, "left")
    return both.select("session_id", F.coalesce("q.lat", "p.lat").alias("start_lat"), F.coalesce("q.lon", "p.lon").alias("start_lon"))


def lap_boundaries(telemetry: DataFrame, starts: DataFrame, tolerance_m: float = 5.0, skip_samples: int = 4, parameters: DataFrame | None = None, chunk: int = 1 << 16) -> DataFrame:
    """session_id, boundaries: greedy crossings of the start, more than skip_samples apart.

    parameters: session_id (lower case), tolerance_m, skip_samples of single
    sessions; files of WIDE have their own without it.

    What a chunk of a session does depends only on how many samples, up to
    skip_samples + 1, have passed since the last boundary when it begins. For
    each such number the chunk's last boundary is found; these short tables are
    composed along the session, and each chunk then finds its boundaries from
    where it really begins.
    """
    t = telemetry.join(starts, "session_id")
    wide = F.lower("session_id").isin(*WIDE)
    usual = {"tolerance": F.when(wide, F.lit(WIDE_M)).otherwise(F.lit(tolerance_m)), "skip": F.when(wide, F.lit(WIDE_SKIP)).otherwise(F.lit(skip_samples))}
    if parameters is None:
        t = t.withColumns(usual)
    else:
        p = parameters.select(F.lower("session_id").alias("name"), F.col("tolerance_m").alias("own_m"), F.col("skip_samples").alias("own_skip")).dropDuplicates(["name"])
        t = t.join(p, F.lower("session_id") == p.name, "left").withColumns({"tolerance": F.coalesce("own_m", usual["tolerance"]), "skip": F.coalesce("own_skip", usual["skip"])})
    near = t.where(haversine_m(F.col("lat"), F.col("lon"), F.col("start_lat"), F.col("start_lon")) < F.col("tolerance"))
    near = near.select("session_id", F.col("sample_idx").cast("long").alias("x"), "skip", F.floor(F.col("sample_idx") / chunk).alias("chunk"))
    c = near.groupBy("session_id", "chunk").agg(F.sort_array(F.collect_list("x")).alias("c"), F.first("skip").alias("skip")).withColumn("begin", F.col("chunk") * chunk)
    step = "(last, x) -> if(x - last > skip, x, last)"
    c = c.withColumn("ends", F.expr(f"transform(sequence(0, skip + 1), since -> aggregate(c, begin - since, {step}))"))
    # a chunk without a boundary leaves the last one as it is
    since = "cast(least(k.begin - a.last, k.skip + 1L) as int)"
    after = f"if(k.ends[{since}] < k.begin, a.last, k.ends[{since}])"
    compose = f"aggregate(chunks, named_struct('last', 0L, 'out', cast(array() as array<struct<chunk:bigint,last:bigint>>)), (a, k) -> named_struct('last', {after}, 'out', array_append(a.out, named_struct('chunk', k.chunk, 'last', a.last))), a -> a.out)"
    chunks = c.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "begin", "skip", "ends"))).alias("chunks"))
    begins = chunks.select("session_id", F.explode(F.expr(compose)).alias("b")).select("session_id", "b.*")
    found = "aggregate(c, named_struct('last', last, 'out', cast(array() as array<bigint>)), (a, x) -> if(x - a.last > skip, named_struct('last', x, 'out', array_append(a.out, x)), a), a -> a.out)"
    each = c.join(begins, ["session_id", "chunk"]).select("session_id", F.struct("chunk", F.expr(found).alias("found")).alias("f"))
    return each.groupBy("session_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["found"])).alias("boundaries"))


def lap_ranges(telemetry: DataFrame, boundaries: DataFrame) -> DataFrame:
    """session_id, range_no, start_idx, end_idx: from the session's first sample to its first boundary, and so on to its last sample.

    Neighbours share their boundary sample; a range of one sample is left out.
    """
    ends = telemetry.groupBy("session_id").agg(F.min("sample_idx").cast("long").alias("first_idx"), F.max("sample_idx").cast("long").alias("last_idx"))
    pairs = "transform(concat(array(first_idx), coalesce(boundaries, array())), (x, i) -> struct(i as range_no, x as start_idx, coalesce(get(boundaries, i), last_idx) as end_idx))"
    r = ends.join(boundaries, "session_id", "left")
    return r.select("session_id", F.explode(F.expr(f"filter({pairs}, p -> p.end_idx > p.start_idx)")).alias("r")).select("session_id", "r.*")


def fallback_ranges(telemetry: DataFrame) -> DataFrame:
    """The whole session as one lap, if it has two samples."""
    n = telemetry.groupBy("session_id").agg(F.min("sample_idx").cast("long").alias("start_idx"), F.max("sample_idx").cast("long").alias("end_idx"))
    return n.select("session_id", F.lit(0).alias("range_no"), "start_idx", "end_idx").where("end_idx > start_idx")


def lap_records(telemetry: DataFrame, ranges: DataFrame) -> DataFrame:
    """Start and end time, duration and distance of each range, from its two end samples."""
    at = F.explode(F.array(*(F.struct(F.lit(x).alias("which"), F.col(f"{x}_idx").alias("sample_idx")) for x in ("start", "end")))).alias("at")
    both = ranges.select("session_id", "range_no", "start_idx", "end_idx", at).select("session_id", "range_no", "start_idx", "end_idx", "at.*")
    samples = telemetry.select("session_id", F.col("sample_idx").cast("long").alias("sample_idx"), "timestamp", F.col("distance_m").alias("d"))
    one = lambda x, c: F.max(F.when(F.col("which") == x, F.col(c)))
    r = both.join(samples, ["session_id", "sample_idx"]).groupBy("session_id", "range_no", "start_idx", "end_idx")
    r = r.agg((F.max((F.col("which") == "start").cast("int")) + F.max((F.col("which") == "end").cast("int"))).alias("found"), *(one(x, c).alias(n) for x, c, n in (("start", "timestamp", "start_time"), ("end", "timestamp", "end_time"), ("start", "d", "start_d"), ("end", "d", "end_d")))).where("found = 2")
    seconds = F.unix_micros(F.to_timestamp("end_time")) - F.unix_micros(F.to_timestamp("start_time"))
    return r.select("session_id", "range_no", "start_time", "end_time", half_up(seconds / 1e6, 5).alias("lap_time_s"), half_up(F.col("end_d") - F.col("start_d"), 3).alias("distance_m"), F.col("start_idx").alias("start_sample_idx"), F.col("end_idx").alias("end_sample_idx"))


def classify_laps(records: DataFrame) -> DataFrame:
    """lap_number and is_partial: of two laps or more the first and last are partial; full laps count from 1."""
    n, k = F.count(F.lit(1)).over(Window.partitionBy("session_id")), F.row_number().over(Window.partitionBy("session_id").orderBy("start_sample_idx"))
    r = records.withColumns({"n": n, "k": k})
    partial = (F.col("n") > 1) & ((F.col("k") == 1) | (F.col("k") == F.col("n")))
    return r.withColumn("is_partial", partial).withColumn("lap_number", F.when(F.col("is_partial") | (F.col("n") == 1), F.col("k")).otherwise(F.col("k") - 1)).drop("n", "k")


def detect_laps(telemetry: DataFrame, starts: DataFrame | None = None, tolerance_m: float = 5.0, skip_samples: int = 4, parameters: DataFrame | None = None, routes: Sequence[str] = ROUTES) -> DataFrame:
    """Lap records of every session, full and partial; sessions without a boundary, and routes, are one lap."""
    timed = telemetry.where(~F.lower("session_id").rlike("|".join(routes))) if routes else telemetry
    found = lap_boundaries(timed, start_points(timed, starts), tolerance_m, skip_samples, parameters)
    return classify_laps(lap_records(telemetry, lap_ranges(telemetry, found)))


def plausible_laps(telemetry: DataFrame, laps: DataFrame, least_s: float = 20.0, least_m: float = 150.0) -> DataFrame:
    """Laps long enough in time and distance, numbered anew, none partial; a session without any is one lap."""
    kept = laps.where((F.col("lap_time_s") >= least_s) & (F.col("distance_m") >= least_m))
    rest = lap_records(telemetry, fallback_ranges(telemetry).join(kept.select("session_id").distinct(), "session_id", "left_anti"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("start_sample_idx"))
    return kept.drop("lap_number", "is_partial").unionByName(rest).withColumns({"lap_number": number, "is_partial": F.lit(False)})


def lap_samples(telemetry: DataFrame, laps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every sample of every lap with lap_number; a shared boundary sample comes once for each of its laps.

    The last lap start so far tells each sample its lap, so no range join is
    needed; the last sample of a lap is joined by its index.
    """
    telemetry = telemetry.drop("lap_number", "start_sample_idx", "end_sample_idx", "pos", "s")
    keys = laps.select("session_id", "lap_number", "start_sample_idx", "end_sample_idx")
    marks = telemetry.join(keys.select("session_id", F.col("start_sample_idx").alias("sample_idx"), F.col("start_sample_idx").alias("s")), ["session_id", "sample_idx"], "left")
    inside = own_rows(add_last(in_chunks(marks, chunk), "start_sample_idx", F.col("s"))).drop("s").join(keys, ["session_id", "start_sample_idx"])
    inside = inside.where("sample_idx < end_sample_idx")
    ends = telemetry.join(keys.withColumn("sample_idx", F.col("end_sample_idx")), ["session_id", "sample_idx"])
    return inside.unionByName(ends).withColumn("pos", F.col("sample_idx") - F.col("start_sample_idx"))


def sector_times(telemetry: DataFrame, laps: DataFrame, sectors: int = 3) -> DataFrame:
    """session_id, lap_number, start_sample_idx, sector_times_s, sector_splits_m.

    A pair of samples can end one sector at most; a boundary that is jumped ends
    the list. The last boundary is the lap's own end.
    """
    lap = Window.partitionBy("session_id", "start_sample_idx").orderBy("sample_idx")
    s = lap_samples(telemetry, laps).select("session_id", "lap_number", "start_sample_idx", "sample_idx", "pos", F.col("distance_m").alias("d"), F.unix_micros(F.to_timestamp("timestamp")).alias("us"))
    whole = lap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"d_before": F.lag("d").over(lap), "us_before": F.lag("us").over(lap), "d0": F.first("d").over(whole), "dn": F.last("d").over(whole), "us0": F.first("us").over(whole)})
    # times count from the lap's start: small numbers keep their digits as doubles
    s = s.withColumns({"us": F.col("us") - F.col("us0"), "us_before": F.col("us_before") - F.col("us0")})
    s = s.where("d_before is not null and dn > d0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(sectors))))
    s = s.withColumn("b", F.when(F.col("k") == sectors, F.col("dn")).otherwise(F.col("d0") + (F.col("dn") - F.col("d0")) * F.col("k") / sectors)).where("d_before <= b and b <= d")
    key = ["session_id", "lap_number", "start_sample_idx"]
    spans = s.groupBy(*key, "k").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    spans = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("spans"))
    pick = "aggregate(spans, named_struct('p', 0L, 'out', cast(array() as array<struct<k:int,pos:bigint>>)), (a, x) -> if(a.p >= 0 and x.k = size(a.out) + 1 and greatest(x.lo, a.p + 1) <= x.hi, named_struct('p', greatest(x.lo, a.p + 1), 'out', array_append(a.out, named_struct('k', x.k, 'pos', greatest(x.lo, a.p + 1)))), named_struct('p', -1L, 'out', a.out)), a -> a.out)"
    picked = spans.select(*key, F.explode(F.expr(pick)).alias("c")).select(*key, "c.k", "c.pos")
    at = s.join(picked, [*key, "k", "pos"]).withColumn("us_at", F.col("us_before") + (F.col("us") - F.col("us_before")) * F.coalesce(F.try_divide(F.col("b") - F.col("d_before"), F.col("d") - F.col("d_before")), F.lit(0.0)))
    order = Window.partitionBy("session_id", "start_sample_idx").orderBy("k")
    at = at.withColumn("t", half_up((F.col("us_at") - F.coalesce(F.lag("us_at").over(order), F.lit(0.0))) / 1e6, 5)).withColumn("split", half_up(F.col("b") - F.col("d0"), 3))
    rows = at.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "t", "split"))).alias("c"))
    return rows.select(*key, F.expr("transform(c, x -> x.t)").alias("sector_times_s"), F.expr("transform(c, x -> x.split)").alias("sector_splits_m"))


def annotate_lap_samples(telemetry: DataFrame, laps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """lap_index, lap_elapsed_s and lap_distance_m of each sample; of two full laps the later has the shared sample."""
    telemetry = telemetry.drop("lap_index", "lap_elapsed_s", "lap_distance_m", "mark", "s", "e", "t0", "d0")
    full = laps.where("not is_partial").select("session_id", F.col("lap_number").alias("lap_index"), F.col("start_sample_idx").alias("s"), F.col("end_sample_idx").alias("e"))
    begin = telemetry.select("session_id", F.col("sample_idx").alias("s"), F.col("elapsed_s").alias("t0"), F.col("distance_m").alias("d0"))
    full = full.join(begin, ["session_id", "s"])
    starts = full.select("session_id", F.col("s").alias("sample_idx"), F.col("s").alias("mark"))
    t = own_rows(add_last(in_chunks(telemetry.join(starts, ["session_id", "sample_idx"], "left"), chunk), "s", F.col("mark")))
    t = t.join(full, ["session_id", "s"], "left")
    inside = F.col("sample_idx") <= F.col("e")
    values = {"lap_index": F.col("lap_index"), "lap_elapsed_s": half_up(F.col("elapsed_s") - F.col("t0"), 3), "lap_distance_m": F.col("distance_m") - F.col("d0")}
    return t.withColumns({k: F.when(inside, v) for k, v in values.items()}).drop("mark", "s", "e", "t0", "d0")


def raw_lap_ids(telemetry: DataFrame, boundaries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """lap: how many boundaries lie before the sample; a boundary sample keeps the old id."""
    b = boundaries.select("session_id", F.explode("boundaries").alias("sample_idx"), F.lit(1).alias("is_boundary"))
    t = in_chunks(telemetry.join(b, ["session_id", "sample_idx"], "left"), chunk).withColumn("is_boundary", F.coalesce("is_boundary", F.lit(0)))
    t = own_rows(add_running_sums(t, {"passed": F.col("is_boundary").cast("double")}))
    return t.withColumn("lap", (F.col("passed") - F.col("is_boundary")).cast("long")).drop("is_boundary", "passed")

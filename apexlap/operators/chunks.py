"""Windows over sessions of any length, chunk by chunk.

A session is cut into chunks of neighbouring samples, and a task takes a chunk,
not a session. What a window needs from across a border comes with it: copies of
the samples around the chunk (a halo), or, for running totals, the totals of the
chunks before, from a table of one row a chunk.

sample_idx counts a session's samples without gaps; where it has gaps, borders
of chunks count the missing samples too. Rows without session_id or sample_idx
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Samples of a chunk.
CHUNK = 1 << 20
KEY = ["session_id", "chunk__"]


def in_chunks(df: DataFrame, size: int = CHUNK, before: int = 0, after: int = 0) -> DataFrame:
    """df with chunk__ and own__; a chunk also has so many samples before and after it, which aren't its own."""
    idx = F.col("sample_idx").cast("long")
    home = F.floor(idx / size)
    df = df.where("session_id is not null and sample_idx is not null")
    if not before and not after:
        return df.withColumns({"chunk__": home, "own__": F.lit(True)})
    near = F.sequence(F.floor((idx - after) / size), F.floor((idx + before) / size))
    return df.withColumn("chunk__", F.explode(near)).withColumn("own__", F.col("chunk__") == home)


def chunk_window() -> WindowSpec:
    """The samples of a chunk in order."""
    return Window.partitionBy(*KEY).orderBy("sample_idx")


def so_far() -> WindowSpec:
    return chunk_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def own_rows(df: DataFrame) -> DataFrame:
    """The samples themselves, without halos."""
    return df.where("own__").drop("chunk__", "own__")


def _before(fold: Column) -> Column:
    return fold.over(Window.partitionBy("session_id").orderBy("chunk__").rowsBetween(Window.unboundedPreceding, -1))


def add_running_sums(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """df (in chunks) with the running sum over the session of each column: sums of the chunks before, and of the chunk so far."""
    own = {f"{n}__part": F.when(F.col("own__"), F.coalesce(c, F.lit(0.0))).otherwise(0.0) for n, c in sums.items()}
    df = df.withColumns(own)
    totals = df.groupBy(*KEY).agg(*(F.sum(n).alias(n) for n in own))
    totals = totals.select(*KEY, *(F.coalesce(_before(F.sum(n)), F.lit(0.0)).alias(f"{n}s") for n in own))
    df = df.join(totals, KEY).withColumns({n: F.col(f"{n}__parts") + F.sum(f"{n}__part").over(so_far()) for n in sums})
    return df.drop(*own, *(f"{n}s" for n in own))


def add_last(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df (in chunks, without halo) with the last non-NULL value of the session up to each sample."""
    df = df.withColumn(f"{name}__here", value)
    ends = df.groupBy(*KEY).agg(F.max_by(f"{name}__here", F.when(F.col(f"{name}__here").isNotNull(), F.col("sample_idx"))).alias("end__"))
    ends = ends.select(*KEY, _before(F.last("end__", ignorenulls=True)).alias(f"{name}__before"))
    df = df.join(ends, KEY)
    return df.withColumn(name, F.coalesce(F.last(f"{name}__here", ignorenulls=True).over(so_far()), f"{name}__before")).drop(f"{name}__here", f"{name}__before")


def session_facts(df: DataFrame, size: int, facts: dict[str, Column]) -> DataFrame:
    """Aggregates of each session, one row for each of its chunks."""
    first, last = F.floor(F.min("sample_idx") / size), F.floor(F.max("sample_idx") / size)
    s = df.groupBy("session_id").agg(F.sequence(first, last).alias("chunk__"), *(c.alias(n) for n, c in facts.items()))
    return s.withColumn("chunk__", F.explode("chunk__"))

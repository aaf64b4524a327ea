"""Exact quantiles of groups of any size, in memory that doesn't grow with them.

Each wanted rank has an interval that holds it, at first from a group's smallest
value to its largest. A pass counts the values of every interval in BINS equal
parts and keeps the part with the rank, from the smallest value in it to the
largest, until that is one value. No pass holds values, only counts, and the
parts of one interval shrink by a factor of BINS from pass to pass.

NULL, NaN and infinite values are left out; a group without any other gives no
row. Quantiles between two ranks are interpolated linearly. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..sources.staging import discard, written

BINS = 1024


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float], bins: int = BINS) -> DataFrame:
    """by.., and a column for each probability (name -> between 0 and 1)."""
    by = list(by)
    values = written(df.select(*by, finite(F.col(value).cast("double")).alias("v")).where("v is not null"), "values")
    size = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    asked = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in probabilities.values()))))
    # rank: from 0 within the interval; of: from 0 within the group
    open_ = written(size.select(*by, "lo", "hi", F.explode(asked).alias("of")).withColumn("rank", F.col("of")), "ranks")
    found = None
    while True:
        done = open_.where("lo = hi").select(*by, "of", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        left = open_.where("lo < hi")
        if left.isEmpty():
            break
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        spans = left.select(*by, "lo", "hi").distinct()
        inside = values.join(spans, by).where("v between lo and hi")
        counted = inside.groupBy(*by, "lo", "hi", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        below = Window.partitionBy(*by, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
        at = left.join(counted, [*by, "lo", "hi"]).where("rank >= below and rank < below + n")
        open_ = written(at.select(*by, F.col("least").alias("lo"), F.col("most").alias("hi"), "of", (F.col("rank") - F.col("below")).alias("rank")), "ranks")
    ranks = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("of", "v"))).alias("at")).join(size.select(*by, "n"), by)
    ranks = written(ranks, "quantiles")
    discard(values)
    low, high = (lambda p, f=f: F.element_at("at", f(place(p))) for f in (F.floor, F.ceil))
    return ranks.select(*by, *((low(p) + (high(p) - low(p)) * (place(p) - F.floor(place(p)))).alias(n) for n, p in probabilities.items()))

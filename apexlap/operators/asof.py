"""The last row at or before a value, or the first at or behind it, in bins.

Rows of a key are dealt to bins of equal width, so that no task holds a whole
key. In a bin rows and questions lie in one order; where a bin has no answer,
that of the nearest bin before (or behind) with a row steps in, from a table of
one row a bin. Work is linear in rows and questions.

Of rows with equal values the one with the greater `tie` counts as later.
Questions and rows with a NULL or NaN value meet nothing: such questions come
back with a NULL answer. Rows must not have columns named like those of a
question. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def _bin(x: Column, width: float) -> Column:
    return F.floor(x / width)


def as_of(questions: DataFrame, rows: DataFrame, by: Sequence[str], x: str, value: str, tie: str, payload: Sequence[str], behind: bool = False, width: float = 100.0) -> DataFrame:
    """questions with `found`, a struct of payload: of the last row of their key with value <= x, or with behind the first with value >= x."""
    key = [*by, "bin__"]
    r = rows.where(_known(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("v__"), F.col(tie).cast("long").alias("t__"), F.struct(*payload).alias("row__"))
    r = r.withColumn("bin__", _bin(F.col("v__"), width))
    # a question follows the rows of its own value, in falling order if the first at or behind it is wanted
    turn = F.desc if behind else F.asc
    mark = r.select(*key, "v__", F.lit(0).alias("side__"), "t__", "row__", F.lit(None).cast(questions.select(F.struct("*").alias("q")).schema["q"].dataType).alias("q__"))
    asked = questions.where(_known(F.col(x).cast("double"))).select(*by, _bin(F.col(x).cast("double"), width).alias("bin__"), F.col(x).cast("double").alias("v__"), F.lit(1).alias("side__"), F.lit(0).cast("long").alias("t__"), F.lit(None).cast(r.schema["row__"].dataType).alias("row__"), F.struct(*questions.columns).alias("q__"))
    w = Window.partitionBy(*key).orderBy(turn("v__"), "side__", turn("t__"))
    inside = F.last("row__", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    edge = (F.min_by if behind else F.max_by)("row__", F.struct("v__", "t__"))
    found = mark.unionByName(asked).withColumn("inside__", inside).where("q__ is not null").select(*key, "q__", "inside__")
    # the answer of other bins, for each bin that is asked in
    bins = r.groupBy(*key).agg(edge.alias("edge__"))
    wanted = asked.select(*key).distinct()
    over = Window.partitionBy(*by).orderBy(turn("bin__")).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("edge__", ignorenulls=True).over(over)
    bins = wanted.join(bins, key, "full_outer").withColumn("carried__", carried).join(wanted, key, "left_semi").select(*key, "carried__")
    done = found.join(bins, key, "left").select("q__.*", F.coalesce("inside__", "carried__").alias("found"))
    unknown = questions.where(~_known(F.col(x).cast("double")) | F.col(x).isNull()).withColumn("found", F.lit(None).cast(done.schema["found"].dataType))
    return done.unionByName(unknown)


def with_previous(rows: DataFrame, by: Sequence[str], value: str, tie: str, previous: dict[str, str], width: float = 100.0) -> DataFrame:
    """rows with columns of the row before (previous: new name -> column), in the order of value and tie, NULL at the first; found in bins."""
    key = [*by, "bin__"]
    r = rows.withColumn("bin__", _bin(F.col(value), width))
    w = Window.partitionBy(*key).orderBy(value, tie)
    r = r.withColumns({"before__": F.lag(F.struct(*previous.values())).over(w)})
    ends = rows.withColumn("bin__", _bin(F.col(value), width)).groupBy(*key).agg(F.max_by(F.struct(*previous.values()), F.struct(value, tie)).alias("end__"))
    ends = ends.withColumn("end__", F.lag("end__").over(Window.partitionBy(*by).orderBy("bin__")))
    r = r.join(ends, key, "left").withColumn("before__", F.coalesce("before__", "end__"))
    return r.withColumns({n: F.col(f"before__.{c}") for n, c in previous.items()}).drop("bin__", "before__", "end__")

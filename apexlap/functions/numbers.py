"""Missing values: NULL stands for absent, unparsable and not-a-number."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_float(text: Column) -> Column:
    """A string as a double; NULL where it is none or NaN."""
    return F.nanvl(F.expr("try_cast(null as double)") if text is None else text.try_cast("double"), F.lit(None).cast("double"))


def half_up(x: Column, digits: int) -> Column:
    """Rounded half away from zero; nine digits come first, so that noise in the last bits can't turn a tie."""
    return F.round(F.round(x, 9), digits)


def rounded(x: Column, digits: int) -> Column:
    """As half_up; NULL for NaN and infinities."""
    return half_up(finite(x), digits)


def preserved(x: Column) -> Column:
    """As it is, with NULL for NaN only."""
    return F.nanvl(x, F.lit(None).cast("double"))

"""Centred smoothing of a column over a window specification."""

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

METHODS = ("ma", "gaussian", "savgol")


def reach(method: str, window: int) -> tuple[int, int]:
    """How many samples before and after one its smoothed value depends on; ValueError for another method or a window it can't use."""
    if method not in METHODS:
        raise ValueError(f"unknown smoothing method {method!r}; choose from {', '.join(METHODS)}")
    if window < 1 or (method == "savgol" and window < 2):
        raise ValueError(f"window {window} is too small for {method}")
    if method == "savgol":
        return window // 2, window // 2
    after = (window - 1) // 2
    return window - 1 - after, after


def smoothed(x: Column, w: WindowSpec, whole: WindowSpec | None = None, method: str = "ma", window: int = 7, ends: tuple[Column, ...] | None = None) -> Column:
    """Moving average and gaussian skip NULLs; the quadratic fit spreads them.

    w orders a session, or a part of one with what `reach` asks for around it.
    The quadratic fit also asks for the session's first and last value, the
    sample's place from 1 and the number of samples: from `ends`, else by whole,
    w without a frame's end.
    """
    before, after = reach(method, window)
    near = [F.lag(x, -o).over(w) if o < 0 else F.lead(x, o).over(w) for o in range(-before, after + 1)]
    if method == "ma":
        return F.avg(x).over(w.rowsBetween(-before, after))
    if method == "gaussian":
        sigma = max(window / 3, 0.5)
        weights = [math.exp(-0.5 * ((j - (window - 1) / 2) / sigma) ** 2) for j in range(window)]
        pairs = list(zip(near, weights, strict=True))
        total = sum((F.coalesce(v * c, F.lit(0.0)) for v, c in pairs), F.lit(0.0))
        return F.try_divide(total, sum((F.when(v.isNotNull(), F.lit(c)).otherwise(0.0) for v, c in pairs), F.lit(0.0)))
    m = before
    first, last, at, size = ends or (F.first(x).over(whole), F.last(x).over(whole), F.row_number().over(w), F.count(F.lit(1)).over(whole))
    out = F.lit(0.0)
    for j in range(-m, m + 1):
        c = 3 * (3 * m * m + 3 * m - 1 - 5 * j * j) / ((2 * m - 1) * (2 * m + 1) * (2 * m + 3)) if m > 1 else float(j == 0)
        v = F.when(at + j < 1, first).when(at + j > size, last).otherwise(F.lead(x, j).over(w) if j > 0 else F.lag(x, -j).over(w))
        out = out + v * c
    return out

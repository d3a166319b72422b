"""Window expressions over one ticker's bars, null until their window is full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def by() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("idx")


def last(n: int):
    return by().rowsBetween(1 - n, 0)


def full(agg: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """agg over the last n rows if all n values are there."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(last(n)) == n, agg(x).over(last(n)))


def back(x: Column | str, k: int) -> Column:
    return F.lag(x, k).over(by())


def ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def zscore(x: Column | str, n: int, flat: float | None = 0.0) -> Column:
    """(x - mean) / population deviation; `flat` where the deviation is 0."""
    x = F.col(x) if isinstance(x, str) else x
    mean, dev = full(F.avg, x, n), full(F.stddev_pop, x, n)
    low, high = full(F.min, x, n), full(F.max, x, n)
    return F.when(low == high, F.lit(flat)).otherwise((x - mean) / F.when(dev != 0, dev))


def sample_skew(x: Column, n: int) -> Column:
    """Bias-corrected; 0 for a constant window."""
    g = F.when(full(F.min, x, n) != full(F.max, x, n), full(F.skewness, x, n))
    some = full(F.min, x, n).isNotNull()
    return F.when(some, F.coalesce(g * ((n * (n - 1)) ** 0.5 / (n - 2)), F.lit(0.0)))


def sample_kurtosis(x: Column, n: int) -> Column:
    """Bias-corrected excess; -3 for a constant window."""
    g = F.when(full(F.min, x, n) != full(F.max, x, n), full(F.kurtosis, x, n))
    some = full(F.min, x, n).isNotNull()
    return F.when(some, F.coalesce(((n + 1) * g + 6) * ((n - 1) / ((n - 2) * (n - 3))), F.lit(-3.0)))

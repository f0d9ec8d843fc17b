"""Aggregate expressions whose treatment of missing values differs from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum_strict(x: str | Column) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def avg_strict(x: str | Column) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def wmean(x: str | Column, w: str | Column, strict: bool = False) -> Column:
    """Weighted mean over rows that have both value and weight.

    With ``strict`` one missing value or weight makes the result NULL.
    """
    x, w = _c(x), _c(w)
    both = x.isNotNull() & w.isNotNull()
    mean = F.try_divide(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))
    if strict:
        return F.when(F.count(F.when(both, F.lit(1))) == F.count(F.lit(1)), mean)
    return mean


def wmean_ratio(a: str | Column, b: str | Column, w: str | Column) -> Column:
    """Weighted mean of the row-wise ratio ``a / b``; rows with ``b = 0`` carry no ratio."""
    return wmean(F.try_divide(_c(a), _c(b)), w)


def null_rate(x: str | Column) -> Column:
    return F.avg(_c(x).isNull().cast("double"))

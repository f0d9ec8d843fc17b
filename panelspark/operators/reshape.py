"""Wide and long forms, and differences between pivoted cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_wider(
    df: DataFrame, ids: Sequence[str], names_from: str, values: Sequence, aggs: dict[str, Column]
) -> DataFrame:
    """One column per (measure, value of ``names_from``), named ``measure_value``.

    The values are given, so no job runs to discover them.
    """
    wide = df.groupBy(*ids).pivot(names_from, list(values)).agg(*[agg.alias(name) for name, agg in aggs.items()])
    if len(aggs) == 1:
        (name,) = aggs
        return wide.select(*ids, *[F.col(f"`{_label(v)}`").alias(f"{name}_{_label(v)}") for v in values])
    return wide.select(
        *ids, *[F.col(f"`{_label(v)}_{name}`").alias(f"{name}_{_label(v)}") for v in values for name in aggs]
    )


def _label(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def pivot_longer(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot_diff(df: DataFrame, ids: Sequence[str], flag: str, measures: Sequence[str]) -> DataFrame:
    """Value where ``flag`` is true minus value where it is false, per id and measure.

    Expects at most one row per id and flag, as after a ``groupBy``.
    """
    f = F.col(flag)
    return df.groupBy(*ids).agg(
        *[(F.max(F.when(f, F.col(m))) - F.max(F.when(~f, F.col(m)))).alias(m) for m in measures]
    )


def envelope(df: DataFrame, measures: Sequence[str], pre: str = "pre", post: str = "post") -> DataFrame:
    """Per measure with ``_pre`` and ``_post`` columns: did it rise, and the lower and upper curve.

    All three are missing when either curve is.
    """
    added = {}
    for m in measures:
        a, b = F.col(f"{m}_{pre}"), F.col(f"{m}_{post}")
        both = a.isNotNull() & b.isNotNull()
        added[f"{m}_increased"] = b > a
        added[f"{m}_lower"] = F.when(both, F.least(a, b))
        added[f"{m}_upper"] = F.when(both, F.greatest(a, b))
    return df.withColumns(added)

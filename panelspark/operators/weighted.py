"""Weighted spread, and summaries of whole columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import wmean
from .joins import sized_join


def weighted_spread(df: DataFrame, keys: Sequence[str], columns: Sequence[str], w: str) -> DataFrame:
    """Weighted mean ``<c>`` and weighted sample deviation ``<c>_sd`` per group.

    sd = sqrt( sum w (x - mean)^2 / ((n - 1) / n * sum w) ), n counting non-zero weights.
    Two passes, because the one-pass formula loses its digits when the mean is large; the
    detail rows meet the group means through a size-checked join.
    """
    keys = list(keys)
    means = df.groupBy(*keys).agg(*[wmean(c, w).alias(f"_m_{c}") for c in columns])
    if keys:
        joined = sized_join(df, means, keys, "inner", written=True)
    else:
        joined = df.withColumns({m: F.lit(v).cast("double") for m, v in means.first().asDict().items()})
    wt = F.col(w)
    aggs = []
    for c in columns:
        x = F.when(wt.isNotNull(), F.col(c))
        n = F.count(F.when((wt != 0) & x.isNotNull(), F.lit(1)))
        total = F.sum(F.when(x.isNotNull(), wt))
        squares = F.sum(wt * (x - F.col(f"_m_{c}")) * (x - F.col(f"_m_{c}")))
        aggs.append(F.first(f"_m_{c}").alias(c))
        aggs.append(F.sqrt(F.try_divide(squares, F.try_divide(n - 1, n) * total)).alias(f"{c}_sd"))
    return joined.groupBy(*keys).agg(*aggs)


def summary_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """N, mean, sd, min and max of each column, one row per column (and group); one pass."""
    stats = df.groupBy(*by).agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("sd"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("s")) for c in columns]))
    return stats.select(*by, rows.alias("r")).select(*by, "r.variable", "r.s.*")


def null_rates(df: DataFrame) -> DataFrame:
    """Share of missing values of every column, one row per column; one pass."""
    one = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    return one.unpivot([], list(df.columns), "column_name", "null_rate")

"""How often values occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .joins import sized_join


def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(out))


def rare_value_flags(df: DataFrame, column: str, rare: str, extreme: str) -> DataFrame:
    """Flag rows whose value occurs less often than the median value, and rows at the extremes.

    The median runs over how many values share each count, a table far smaller than the
    values themselves.
    """
    # counted once, used three times
    counts = checkpointed(value_counts(df, column, "_n"))
    median = (
        counts.groupBy("_n")
        .agg(F.count(F.lit(1)).alias("_f"))
        .agg(F.percentile("_n", 0.5, F.col("_f")))
        .first()[0]
    )
    # two rows at most
    ends = counts.agg(F.array_distinct(F.array(F.min(column), F.max(column))).alias("_ends"))
    ends = ends.select(F.explode("_ends").alias(column), F.lit(True).alias("_end"))
    flags = counts.join(F.broadcast(ends), [column], "left").select(
        column,
        (F.col("_n") < F.lit(median)).alias(rare),
        F.coalesce("_end", F.lit(False)).alias(extreme),
    )
    return sized_join(df, flags, [column], "left")

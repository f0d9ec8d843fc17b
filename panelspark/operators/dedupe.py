"""Keeping one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return True


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key under ``order``.

    ``order`` lists column names; a leading ``-`` means descending, as in ``['run', '-version']``.
    A missing value loses in either direction. Rows that tie on every order column are
    separated by their remaining columns, so the answer does not depend on partitioning.

    Written as row number = 1, which Spark limits to one row per key inside every map task
    before it shuffles: a key holding a large share of all rows costs one row per task.
    """
    keys = list(keys)
    rest = [f for f in df.schema.fields if f.name not in keys]
    if not rest:
        return df.distinct()
    sort = []
    for spec in order:
        name = spec.removeprefix("-")
        column = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            # not a number counts as missing
            column = F.nanvl(column, F.lit(None).cast("double"))
        sort.append(column.desc_nulls_last() if spec.startswith("-") else column.asc_nulls_last())
    used = {spec.removeprefix("-") for spec in order}
    sort += [F.col(f"`{f.name}`").desc_nulls_last() for f in rest if f.name not in used and _orderable(f.dataType)]
    first = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*sort)
    return df.withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1).drop("_first")


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all inputs, aligned by name, each distinct row once."""
    for other in others:
        first = first.unionByName(other)
    return first.distinct()

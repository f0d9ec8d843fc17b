"""Regular calendars and completing a table to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_grid(keys: DataFrame, start: Column, end: Column, step: str, out: str) -> DataFrame:
    """One row per key and step from ``start`` to ``end`` inclusive (``step`` as in '30 minutes', '1 day')."""
    return keys.withColumn(out, F.explode(F.sequence(start, end, F.expr(f"INTERVAL {step}"))))


def span(df: DataFrame, t: str) -> tuple[Column, Column]:
    """Earliest and latest value of a date or timestamp column, as literals of its type."""
    dtype = df.schema[t].dataType
    return tuple(F.lit(v).cast(dtype) for v in df.agg(F.min(t).cast("string"), F.max(t).cast("string")).first())


def complete(
    df: DataFrame, keys: Sequence[str], t: str, step: str, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Give every key every step of the whole time span; new rows have NULL in the other columns.

    Missing bounds are taken from the data. Each missing row comes out of its key's own
    ``sequence``; existing rows are joined back on the full key.
    """
    keys = list(keys)
    groups = df.select(*keys).distinct()
    if start is None or end is None:
        low, high = span(df, t)
        start, end = low if start is None else start, high if end is None else end
    grid = time_grid(groups, start, end, step, t)
    return grid.join(df, [*keys, t], "left").select(*df.columns)

"""Data checks: many conditions, one pass, one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """Raised with the names of the checks that did not hold."""


def every_row(condition: Column) -> Column:
    """Holds on every row; an unknown answer counts as a violation."""
    return F.coalesce(F.min(F.coalesce(condition, F.lit(False))), F.lit(True))


def at_most(n: int, condition: Column) -> Column:
    """Holds on no more than ``n`` rows."""
    return F.count(F.when(condition, F.lit(1))) <= F.lit(n)


def some_row(condition: Column) -> Column:
    return F.coalesce(F.max(F.coalesce(condition, F.lit(False))), F.lit(False))


def not_empty() -> Column:
    return F.count(F.lit(1)) > 0


def no_nulls(df: DataFrame, except_like: str | None = None) -> dict[str, Column]:
    """One check per column: no missing values."""
    import re

    return {
        f"{c} has no NULL": every_row(F.col(f"`{c}`").isNotNull())
        for c in df.columns
        if not (except_like and re.search(except_like, c))
    }


def verdicts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, holds) for aggregate conditions over ``df``, all taken in one scan."""
    names = list(checks)
    one = df.agg(*[check.cast("boolean").alias(f"_{i}") for i, check in enumerate(checks.values())])
    rows = F.explode(
        F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"_{i}").alias("holds")) for i, n in enumerate(names)])
    )
    return one.select(rows.alias("r")).select("r.check", "r.holds")


def expect(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Run the checks and hand ``df`` on, or raise naming those that failed."""
    failed = [row["check"] for row in verdicts(df, checks).collect() if not row["holds"]]
    if failed:
        raise ExpectationError("; ".join(failed))
    return df

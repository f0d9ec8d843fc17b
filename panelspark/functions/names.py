"""Column naming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snake(name: str) -> str:
    """``'Daily max (Degree C)'`` -> ``daily_max_degree_c``; ``REGIONID`` -> ``regionid``."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[^0-9A-Za-z]+", "_", spaced).strip("_").lower()


def snake_case(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; clashes get a running number."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        base = snake(column)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def with_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Attach a human-readable label to columns, kept in the schema as a comment."""
    return df.select(
        *[
            F.col(f"`{c}`").alias(c, metadata={"comment": labels[c]}) if c in labels else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def label_code(df: DataFrame, column: str, out: str) -> DataFrame:
    """Number the distinct values of ``column`` 1, 2, ... in ascending order.

    The codes are worked out on the distinct values, range by range if there are very many.
    """
    from ..operators.chunks import number_rows
    from ..operators.joins import sized_join
    from ..session import checkpointed

    labels = checkpointed(df.select(column).where(F.col(column).isNotNull()).distinct())
    codes = number_rows(labels, [], [column], out).withColumn(out, F.col(out).cast("int"))
    return sized_join(df, codes, [column], "left", written=True)

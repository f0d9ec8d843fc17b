"""Result tables in long and side-by-side form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .wls import Fit, coefficient_table, stat_table

# Significance marks and the p-values below which they apply.
STARS = {"***": 0.001, "**": 0.01, "*": 0.05}


def stars(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    mark = F.lit("")
    for text, limit in sorted(STARS.items(), key=lambda s: -s[1]):
        mark = F.when(p < limit, text).otherwise(mark)
    return mark


def model_table(spark: SparkSession, fits: dict[str, Fit], stats: tuple[str, ...] = ("r2", "r2_a")) -> DataFrame:
    """One row per term (and statistic), one column per model: ``coef`` with stars, ``(se)``.

    Built from the handful of coefficients, never from the data.
    """
    coefs = coefficient_table(spark, fits).select(
        "model",
        F.col("term").alias("row"),
        F.format_string("%.6g%s (%.6g)", "coef", stars("p"), "se").alias("cell"),
    )
    extra = stat_table(spark, fits).where(F.col("stat").isin(*stats, "n")).select(
        "model", F.col("stat").alias("row"), F.format_string("%.6g", "value").alias("cell")
    )
    return coefs.unionByName(extra).groupBy("row").pivot("model", list(fits)).agg(F.first("cell"))

"""Small side inputs: holiday lists, clock changes and the population sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import pivot_longer
from ..plans.panel import STUDY_DAYS


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Merged holidays (date, regionid)."""
    raw = read_text_table(spark, path)
    return raw.select(F.to_date(raw.columns[0]).alias("date"), F.col(raw.columns[1]).alias("regionid"))


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path).select(F.to_date("date").alias("date"), "direction")


# Meaning of the sheet's last nine columns.
POPULATION_COLUMNS = ("NSW1", "VIC1", "QLD1", "SA1", "WA1", "TAS1", "NT1", "ACT1", "AUS")
POPULATION_REGIONS = ("NSW1", "VIC1", "QLD1", "SA1", "TAS1")


def population_sheet(sheet: DataFrame, start: str = STUDY_DAYS[0], end: str = STUDY_DAYS[1]) -> DataFrame:
    """(date, regionid, population) from a spreadsheet export.

    The first column is ``Mon-YYYY``; rows whose first column is anything else are preamble.
    The last nine columns are the areas. The capital territory counts towards NSW1.
    """
    month = sheet.columns[0]
    areas = sheet.columns[-len(POPULATION_COLUMNS):]
    data = sheet.where(F.col(f"`{month}`").rlike(r"^[A-Z][a-z]{2}-\d{4}$")).select(
        F.to_date(F.col(f"`{month}`"), "MMM-yyyy").alias("date"),
        *[F.col(f"`{c}`").try_cast("double").alias(n) for c, n in zip(areas, POPULATION_COLUMNS)],
    )
    joined = data.withColumn("NSW1", F.col("NSW1") + F.col("ACT1")).where(
        F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    return pivot_longer(joined.select("date", *POPULATION_REGIONS), ["date"], POPULATION_REGIONS, "regionid", "population")

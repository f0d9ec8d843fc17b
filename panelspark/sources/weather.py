"""Daily weather, one CSV file per city."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import KWH_PER_MJ
from ..operators.quality import every_row, expect, not_empty
from ..plans.panel import STUDY_DAYS

# Region of each city; temperature is taken at capitals, sun and wind inland.
CAPITAL_REGIONS = {
    "adelaide": "SA1",
    "brisbane": "QLD1",
    "sydney": "NSW1",
    "melbourne": "VIC1",
    "hobart": "TAS1",
}
INLAND_REGIONS = {
    "cooberpedy": "SA1",
    "richmond": "QLD1",
    "dubbo": "NSW1",
    "bendigo": "VIC1",
    "hobart": "TAS1",
}
# Names of the measurement columns.
TEMPERATURE_COLUMN = "Maximum temperature (Degree C)"
SUNSHINE_COLUMN = "Daily global solar exposure (MJ/m*m)"


def read_city_files(
    spark: SparkSession,
    path: str,
    pattern: str,
    regions: dict[str, str],
    column: str,
    value: str,
    start: str = STUDY_DAYS[0],
    end: str = STUDY_DAYS[1],
) -> DataFrame:
    """(regionid, date_local, value) of all files; ``pattern`` captures the city in the file name.

    No file at all, or a city that is not in ``regions``, is an error.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    lookup = F.create_map(*[F.lit(x) for pair in regions.items() for x in pair])
    city = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
    parts = [F.col(c).try_cast("int") for c in ("Year", "Month", "Day")]
    rows = raw.select(
        F.try_element_at(lookup, city).alias("regionid"),
        F.make_date(*parts).alias("date_local"),
        F.col(f"`{column}`").try_cast("double").alias(value),
    )
    checked = expect(
        rows,
        {
            f"there are {value} files": not_empty(),
            f"every {value} file has a known region": every_row(F.col("regionid").isNotNull()),
        },
    )
    return checked.where(F.col("date_local").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_temperature(spark: SparkSession, path: str, **days) -> DataFrame:
    return read_city_files(
        spark, path, r"^weather_(.+)\.csv$", CAPITAL_REGIONS, TEMPERATURE_COLUMN, "temperature", **days
    )


def read_sunshine(spark: SparkSession, path: str, **days) -> DataFrame:
    """Solar exposure in kWh per square metre."""
    mj = read_city_files(
        spark, path, r"^sunshine-(.+)\.csv$", INLAND_REGIONS, SUNSHINE_COLUMN, "solar_exposure", **days
    )
    return mj.withColumn("solar_exposure", F.col("solar_exposure") * KWH_PER_MJ)

"""The catalogue of tables: column types, keys and what to leave out.

A catalogue is a table (table_name, column_name, ordinal, source_type, is_pk).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import sized_join

# Columns nobody needs, in the tables so large that it matters.
LARGE_TABLES = ("DISPATCHLOAD", "DISPATCHREGIONSUM")
UNWANTED_COLUMNS = "^(?i)(RAISE|LOWER|VIOLATION|MARGINAL)"
# Types the catalogue states wrongly.
TYPE_OVERRIDES = {
    ("DUDETAIL", "REGISTEREDCAPACITY"): "NUMBER(3,2)",
    ("DUDETAIL", "MAXCAPACITY"): "NUMBER(3,2)",
}


# Decimal digits that always fit, by type; longer numbers are bigint.
WHOLE_NUMBERS = {T.ByteType(): 2, T.ShortType(): 4, T.IntegerType(): 9}


def source_type_to_spark(source_type: str, decimals: bool = False) -> T.DataType:
    """Spark type of a database type name.

    ``DATE`` carries a time of day without a zone. Numbers with decimals are doubles, or
    exact decimals if asked for.
    """
    name = source_type.strip().upper()
    if re.fullmatch(r"(VARCHAR2?|CHAR)\s*\(\d+\)", name):
        return T.StringType()
    if name == "DATE" or re.fullmatch(r"TIMESTAMP\s*\(\d\)", name):
        return T.TimestampNTZType()
    number = re.fullmatch(r"NUMBER\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", name)
    if number:
        digits, scale = int(number[1]), int(number[2] or 0)
        if scale == 0:
            return next((kind for kind, fits in WHOLE_NUMBERS.items() if digits <= fits), T.LongType())
        return T.DecimalType(min(digits, 38), min(scale, digits, 38)) if decimals else T.DoubleType()
    raise ValueError(f"no Spark type for {source_type!r}")


def spark_type_column(source_type: str) -> Column:
    """The same rules as a column: type name as text, NULL where there is none."""
    name = F.upper(F.trim(F.col(source_type)))
    digits = F.regexp_extract(name, r"^NUMBER\s*\(\s*(\d+)", 1).try_cast("int")
    scale = F.coalesce(F.regexp_extract(name, r",\s*(\d+)\s*\)$", 1).try_cast("int"), F.lit(0))
    found = (
        F.when(name.rlike(r"^(VARCHAR2?|CHAR)\s*\(\d+\)$"), F.lit("string"))
        .when((name == "DATE") | name.rlike(r"^TIMESTAMP\s*\(\d\)$"), F.lit("timestamp_ntz"))
        .when(digits.isNotNull() & (scale > 0), F.lit("double"))
    )
    for kind, fits in WHOLE_NUMBERS.items():
        found = found.when(digits <= fits, F.lit(kind.simpleString()))
    return found.when(digits.isNotNull(), F.lit("bigint"))


def borrow_types(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Types for columns the catalogue does not describe, taken from other tables' columns of that name.

    ``wanted`` is (table_name, column_name, ordinal, is_pk). The last table in catalogue order
    wins. Raises if a column is found nowhere.
    """
    by_name = catalogue.groupBy("column_name").agg(F.max_by("source_type", "table_ordinal").alias("source_type"))
    found = sized_join(wanted, by_name, ["column_name"], "left")
    missing = [r[0] for r in found.where(F.col("source_type").isNull()).select("column_name").limit(20).collect()]
    if missing:
        raise ValueError(f"no table has a type for {', '.join(missing)}")
    return found


def override_types(catalogue: DataFrame, overrides: dict[tuple[str, str], str] = TYPE_OVERRIDES) -> DataFrame:
    fixed = F.col("source_type")
    for (table, column), source_type in overrides.items():
        here = (F.col("table_name") == table) & (F.col("column_name") == column)
        fixed = F.when(here, F.lit(source_type)).otherwise(fixed)
    return catalogue.withColumn("source_type", fixed)


def columns_to_drop(
    catalogue: DataFrame, tables: Sequence[str] = LARGE_TABLES, unwanted: str = UNWANTED_COLUMNS
) -> DataFrame:
    """(table_name, column_name) of unwanted columns outside the primary key."""
    return catalogue.where(
        F.col("table_name").isin(*tables) & F.col("column_name").rlike(unwanted) & ~F.col("is_pk")
    ).select("table_name", "column_name")


def table_schema(catalogue: DataFrame, table: str, decimals: bool = False) -> T.StructType:
    """Schema of one table; a catalogue lists a table's columns, so few rows come to the driver."""
    rows = catalogue.where(F.col("table_name") == table).orderBy("ordinal").select("column_name", "source_type").collect()
    if not rows:
        raise ValueError(f"{table} is not in the catalogue")
    return T.StructType([T.StructField(r[0], source_type_to_spark(r[1], decimals)) for r in rows])


def unknown_types(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows whose type has no Spark equivalent."""
    return catalogue.where(spark_type_column("source_type").isNull())

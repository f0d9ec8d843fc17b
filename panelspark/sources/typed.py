"""Text values to typed columns, and compact Parquet output."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import ExpectationError
from ..session import scratch_folder

# The two ways a timestamp is written.
TIMESTAMP_FORMATS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.SSS")
# Types of the columns that tell copies of a row apart.
VERSION_COLUMNS = {"schema_version": T.ByteType(), "top_timestamp": T.StringType()}


def typed(text: Column, dtype: T.DataType) -> Column:
    """Cast text, giving NULL (not an error) for what does not fit; empty text is NULL."""
    value = F.when(F.trim(text) != "", text)
    if isinstance(dtype, T.TimestampNTZType):
        parsed = [F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in TIMESTAMP_FORMATS]
        return F.coalesce(*parsed)
    return value.try_cast(dtype)


def unreadable(text: Column, dtype: T.DataType) -> Column:
    """Whether a value is there but does not fit its type, so that :func:`typed` makes it NULL."""
    return F.coalesce((F.trim(text) != "") & typed(text, dtype).isNull(), F.lit(False))


def reject_counts(rows: DataFrame, schema: T.StructType, values: str = "values") -> DataFrame:
    """(column_name, filled, rejected) of one table's data rows, taken in one scan.

    ``filled`` counts values that are not empty, ``rejected`` those of them that do not fit their type.
    """
    counts = []
    for field in schema.fields:
        text = F.try_element_at(F.col(values), F.lit(field.name))
        counts += [F.count_if(F.trim(text) != ""), F.count_if(unreadable(text, field.dataType))]
    one = rows.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts)])
    lines = [
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"_{2 * i}").alias("filled"), F.col(f"_{2 * i + 1}").alias("rejected"))
        for i, f in enumerate(schema.fields)
    ]
    return one.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def watch_rejects(rows: DataFrame, schema: T.StructType, seen: Observation, values: str = "values") -> DataFrame:
    """``rows`` unchanged; once a job has read them, ``seen.get`` holds the rejected values per column.

    The counts are metrics of that job itself, so a load is checked without a second scan:
    ``expect_readable(seen)`` raises where there are any.
    """
    found = [
        F.count_if(unreadable(F.try_element_at(F.col(values), F.lit(f.name)), f.dataType)).alias(f.name) for f in schema.fields
    ]
    return rows.observe(seen, *found)


def expect_readable(seen: Observation, at_most: int = 0) -> None:
    """Raise if a watched load met more than ``at_most`` rejected values in a column."""
    bad = {name: n for name, n in sorted(seen.get.items()) if n > at_most}
    if bad:
        raise ExpectationError("; ".join(f"{name}: {n} unreadable values" for name, n in bad.items()))


def typed_table(rows: DataFrame, schema: T.StructType, values: str = "values", drop: Sequence[str] = ()) -> DataFrame:
    """Data rows of one table (map column -> text) as typed columns, aligned by name.

    A column the file lacks, or one in ``drop``, is NULL.
    """
    columns = []
    for field in schema.fields:
        if field.name in drop:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            text = F.try_element_at(F.col(values), F.lit(field.name))
            columns.append(typed(text, field.dataType).alias(field.name))
    extra = [
        typed(F.col(name), dtype).alias(name) for name, dtype in VERSION_COLUMNS.items() if name in rows.columns
    ]
    return rows.select(*columns, *extra)


def read_typed_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """CSV files (plain or gzip) below ``path``, columns found by header name, typed.

    Every path of a list is read by its own header, so files with other columns, or the same in
    another order, belong in another path; a file below a path whose header differs from that
    path's raises instead of being read by position. Columns a path lacks are NULL. Set
    ``multi_line`` where quoted values hold line breaks. Folder names ``key=value`` become columns.
    """
    paths = [path] if isinstance(path, str) else list(path)
    read = [_read_one_header(spark, p, schema, multi_line) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def _read_one_header(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    options = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line).option("escape", '"')
    found = options.csv(path)
    # the header of every file is compared with this one
    raw = options.option("enforceSchema", False).schema(found.schema).csv(path)
    present = {c.upper(): c for c in raw.columns}
    columns = [
        typed(F.col(f"`{present[f.name.upper()]}`").cast("string"), f.dataType).alias(f.name)
        if f.name.upper() in present
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    extra = [
        typed(F.col(f"`{present[name.upper()]}`").cast("string"), dtype).alias(name)
        for name, dtype in VERSION_COLUMNS.items()
        if name.upper() in present
    ]
    return raw.select(*columns, *extra)


def write_compacted(df: DataFrame, path: str, partition_by: Sequence[str] = (), max_records: int = 20_000_000) -> None:
    """Write Parquet with few large files, replacing only the partitions that receive rows.

    A rebalance lets the engine split a partition value that holds many rows and merge small ones.
    """
    writer = df.hint("rebalance", *partition_by).write.mode("overwrite").option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def write_by_month(df: DataFrame, path: str, ts: str, *keys: str) -> None:
    """Partitioned rewrite by (keys, year, month) of a timestamp."""
    dated = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    write_compacted(dated, path, [*keys, "year", "month"])


def write_tables(mapped: DataFrame, path: str) -> None:
    """Data rows of all tables to one folder per table, values still as text."""
    write_compacted(mapped, path, ["table_name"])


def write_typed_tables(mapped: DataFrame, schemas: dict[str, T.StructType], path: str) -> DataFrame:
    """Every table of ``schemas`` to ``path/<table>``, typed by its own schema; result: (table_name, column_name, filled, rejected).

    Rows are staged once by table, so each table then reads its own folder only. Rows of tables without a
    schema are left in the staging folder. The counts come from the staged rows, table by table.
    """
    spark = mapped.sparkSession
    staged = scratch_folder(spark, "tables")
    write_tables(mapped, staged)
    whole = spark.read.schema(mapped.schema).parquet(staged)
    counts = []
    for name, schema in schemas.items():
        rows = whole.where(F.col("table_name") == name)
        write_compacted(typed_table(rows, schema), f"{path}/{name}")
        counts.append(reject_counts(rows, schema).select(F.lit(name).alias("table_name"), "column_name", "filled", "rejected"))
    return reduce(DataFrame.unionByName, counts)

"""Reports that hold several tables one after the other.

The first field of a record is its kind: ``C`` comment, ``I`` header of the table that
follows, ``D`` data row of the current table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.chunks import Carry, over_chunks
from ..operators.joins import sized_join

FILE_KEY = ("path", "member")
# Fields in front of the data, the placeholder of an empty report name, the closing record.
LEAD_FIELDS = 4
NULL_NAME = "NULL"
END_MARK = "END OF REPORT"
# What validate_sections calls a file with an error when it is not asked for the error itself.
UNREADABLE = "unreadable"
# Fixed value: the one report whose closing count is not to be trusted.
UNCOUNTED_REPORTS = ("PUBLIC_PDR_CONFIG_non_mms_data_model.CSV",)


def _kind() -> Column:
    return F.get("fields", F.lit(0))


def attach_headers(records: DataFrame, file_key: Sequence[str] = FILE_KEY, **sizing) -> DataFrame:
    """Add ``header`` (latest I record) and ``lead`` (first record) to plain numbered records.

    The container reader already supplies both. Here the header is carried forward in chunks,
    so that a file holding a large share of all records does not land in one task.
    """
    marked = records.withColumns(
        {
            "header": F.when(_kind() == "I", F.col("fields")),
            "lead": F.when(F.col("record_no") == 1, F.col("fields")),
        }
    )

    def compute(w: WindowSpec) -> dict[str, Column]:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return {c: F.last(c, ignorenulls=True).over(upto) for c in ("header", "lead")}

    def latest(c: str) -> Carry:
        summary = F.max_by(c, F.when(F.col(c).isNotNull(), F.col("record_no")))
        return Carry(summary, lambda name, others: F.last(name, ignorenulls=True).over(others))

    before = {c: latest(c) for c in ("header", "lead")}
    return over_chunks(marked, list(file_key), ["record_no"], compute, before=before, **sizing)


def top_timestamp(lead: Column) -> Column:
    """Creation time in fields 5 and 6 of the first record, made fit for a folder name."""
    stamp = F.concat_ws("_", F.get(lead, F.lit(5)), F.get(lead, F.lit(6)))
    return F.translate(stamp, "/ :\\", "____")


def validate_sections(
    records: DataFrame,
    file_key: Sequence[str] = FILE_KEY,
    uncounted: Sequence[str] = UNCOUNTED_REPORTS,
    error_texts: bool = True,
) -> DataFrame:
    """One row per file: (path, member, is_report, problem), problem NULL for a sound report.

    A report starts with a C record, holds C, I and D records only, and ends with
    ``C,END OF REPORT,n`` where n is the number of records or one less; nothing follows.
    A file that does not start with C is no report, which is not a problem. One partial
    aggregate, whatever the size of a file. The problem of a file with an ``error`` is that text, for which
    all records are sorted, or ``UNREADABLE`` without ``error_texts``.
    """
    no, kind = F.col("record_no"), _kind()
    filled = F.size("fields") > 0
    is_end = (kind == "C") & (F.get("fields", F.lit(1)) == END_MARK)
    failed = "error" in records.columns
    # numbers and flags instead of texts: they are added up in hash tables, texts only after sorting all records
    marks = records.select(
        *file_key,
        no.alias("_no"),
        (kind == "C").alias("_starts"),
        F.when(is_end, no).alias("_ends"),
        F.when(is_end, F.try_element_at("fields", F.lit(-1)).try_cast("bigint")).alias("_says"),
        F.when(filled, no).alias("_filled"),
        F.when(~filled, no).alias("_empty"),
        F.when(filled & ~kind.isin("C", "I", "D"), no).alias("_strange"),
        *([F.col("error") if error_texts else F.col("error").isNotNull().alias("error")] if failed else []),
    )
    facts = marks.groupBy(*file_key).agg(
        F.min_by("_starts", "_no").alias("_first"),
        F.min("_ends").alias("_end"),
        F.min_by("_says", "_ends").alias("_count"),
        F.max("_filled").alias("_last"),
        F.min("_empty").alias("_blank"),
        F.min("_strange").alias("_odd"),
        F.max("error").alias("_error") if failed else F.lit(None).cast("string").alias("_error"),
    )
    if failed and not error_texts:
        facts = facts.withColumn("_error", F.when(F.col("_error"), F.lit(UNREADABLE)))
    declared = F.col("_count")
    name = F.element_at(F.split(F.col(file_key[-1]), "/"), -1)
    counted = declared.isin(F.col("_end"), F.col("_end") - 1) | name.isin(*uncounted)
    problem = (
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(~F.col("_first"), F.lit(None))
        .when(F.col("_odd") < F.coalesce(F.col("_end"), F.col("_last") + 1), F.lit("unexpected kind of record"))
        .when(F.col("_end").isNull(), F.lit("no closing record"))
        .when(F.col("_last") > F.col("_end"), F.lit("records after the end"))
        .when(F.col("_blank") < F.col("_end"), F.lit("blank record"))
        .when(~F.coalesce(counted, F.lit(False)), F.lit("closing count does not match"))
    )
    return facts.select(*file_key, F.coalesce("_first", F.lit(False)).alias("is_report"), problem.alias("problem"))


def split_good_bad(records: DataFrame, verdicts: DataFrame, file_key: Sequence[str] = FILE_KEY) -> tuple[DataFrame, DataFrame]:
    """Records of sound files, and (path, member, problem) of the files set aside."""
    bad = verdicts.where(F.col("problem").isNotNull()).select(*file_key, "problem")
    good = sized_join(records, bad.select(*file_key), list(file_key), "left_anti", written=True)
    return good, bad


def split_sections(records: DataFrame, file_key: Sequence[str] = FILE_KEY) -> DataFrame:
    """Data rows with the report they belong to and their values by column name.

    A narrow step: nothing is shuffled. Result: file key, record_no, report_name,
    report_subtype, schema_version, top_timestamp, values (map column -> text).
    """
    header, fields = F.col("header"), F.col("fields")
    rows = records.where(
        (_kind() == "D") & header.isNotNull() & (F.get(F.col("lead"), F.lit(0)) == "C")
    )

    def named(at: int) -> Column:
        name = F.get(header, F.lit(at))
        return F.when(F.coalesce(name, F.lit("")) == "", F.lit(NULL_NAME)).otherwise(name)

    names = F.slice(header, LEAD_FIELDS + 1, F.greatest(F.size(header) - LEAD_FIELDS, F.lit(0)))
    # as many values as there are names; a short row ends in missing values
    values = F.transform(names, lambda _, i: F.get(fields, i + LEAD_FIELDS))
    return rows.select(
        *file_key,
        "record_no",
        named(1).alias("report_name"),
        named(2).alias("report_subtype"),
        F.get(header, F.lit(3)).alias("schema_version"),
        top_timestamp(F.col("lead")).alias("top_timestamp"),
        F.map_from_arrays(names, values).alias("values"),
    )


# Reports the mapping does not list.
REPORT_EXCEPTIONS = {
    ("DISPATCH", "CASESOLUTION"): "DISPATCHCASESOLUTION",
    ("GENCONSETTRK", "NULL"): "GENCONSETTRK",
    ("DISPATCH", "REGIONFCASREQUIREMENT"): "DISPATCH_FCAS_REQ",
    ("CO2EII", "PUBLISHING"): "CO2EII_AVAILABLE_GENERATORS",
}
# Tables the study leaves out because of their size; pass them as ``skip``.
SKIPPED_TABLES = (
    "P5MIN_UNITSOLUTION",
    "P5MIN_CASESOLUTION",
    "P5MIN_CONSTRAINTSOLUTION",
    "P5MIN_LOCALPRICE",
    "DISPATCH_LOCALPRICE",
    "NETWORK_OUTAGEDETAIL",
    "MCC_CASESOLUTION",
    "MCC_CONSTRAINTSOLUTION",
    "DISPATCHOFFERTRK",
    "DISPATCHCASESOLUTION",
    "P5MIN_REGIONSOLUTION",
    "DISPATCHCONSTRAINT",
    "SETFCASREGIONRECOVERY",
    "TRADINGPRICE",
)


def map_tables(
    rows: DataFrame,
    mapping: DataFrame,
    exceptions: dict[tuple[str, str], str] = REPORT_EXCEPTIONS,
    skip: Sequence[str] = (),
    only: Sequence[str] = (),
) -> DataFrame:
    """Add ``table_name`` by (report_name, report_subtype); rows without a wanted table drop out.

    ``mapping`` has (report_name, report_subtype, table_name), an empty name meaning 'NULL'.
    A pair that maps to two tables maps to none; ``exceptions`` apply to pairs it lacks.
    """
    keys = ["report_name", "report_subtype"]
    tidy = mapping.select(
        *[F.when(F.coalesce(F.col(k), F.lit("")) == "", F.lit(NULL_NAME)).otherwise(F.col(k)).alias(k) for k in keys],
        "table_name",
    )
    lookup = tidy.groupBy(*keys).agg(
        F.when(F.min("table_name") == F.max("table_name"), F.min("table_name")).alias("_mapped"),
        F.lit(True).alias("_listed"),
    )
    extra = F.lit(None).cast("string")
    for (name, subtype), table in exceptions.items():
        extra = F.when((F.col(keys[0]) == name) & (F.col(keys[1]) == subtype), F.lit(table)).otherwise(extra)
    joined = sized_join(rows, lookup, keys, "left")
    table = F.when(F.col("_listed"), F.col("_mapped")).otherwise(extra)
    mapped = joined.withColumn("table_name", table).drop("_mapped", "_listed").where(F.col("table_name").isNotNull())
    if skip:
        mapped = mapped.where(~F.col("table_name").isin(*skip))
    return mapped.where(F.col("table_name").isin(*only)) if only else mapped

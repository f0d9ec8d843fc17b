"""Records of sound files only, committed in two phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import sized_join
from ..session import written
from .containers import read_problems
from .sections import FILE_KEY, UNREADABLE, validate_sections

INVALID = "InvalidReport"


def commit_sound(records: DataFrame, sink: str, **known) -> DataFrame:
    """Write records of sound files to ``sink``, set the others aside; result: the files set aside.

    A reader hands on the first records of a file before it meets what is wrong with it, so records
    are staged first, in one reading of the archives, and every file is judged whole. Then
    ``sink/records`` gets the records of files without a problem, ``sink/quarantine`` the others as
    (path, member, error, error_class, severity), and, last, ``sink/manifest`` the sound files
    with their number of records: without a manifest nothing counts as committed. A rerun replaces all three.
    ``known`` goes to :func:`read_problems`.
    """
    staged = written(records, "staged-records")
    unreadable = read_problems(staged, **known)
    verdicts = validate_sections(staged, error_texts=False)
    invalid = verdicts.where(F.col("problem") != UNREADABLE).select(
        *FILE_KEY, F.col("problem").alias("error"), F.lit(INVALID).alias("error_class"), F.lit("error").alias("severity")
    )
    # a file meets one problem, as reading it ends there
    aside = unreadable.dropDuplicates(list(FILE_KEY)).unionByName(invalid)
    spark = records.sparkSession
    aside.write.mode("overwrite").parquet(f"{sink}/quarantine")
    bad = spark.read.parquet(f"{sink}/quarantine")
    sound = sized_join(staged, bad.select(*FILE_KEY), list(FILE_KEY), "left_anti", distinct=True)
    sound.drop("error", "error_class").write.mode("overwrite").parquet(f"{sink}/records")
    kept = spark.read.parquet(f"{sink}/records")
    kept.groupBy(*FILE_KEY).agg(F.count(F.lit(1)).alias("records")).write.mode("overwrite").parquet(f"{sink}/manifest")
    return bad


def read_committed(spark: SparkSession, sink: str) -> DataFrame:
    """The records of a finished commit; without a manifest it raises."""
    spark.read.parquet(f"{sink}/manifest")
    return spark.read.parquet(f"{sink}/records")

"""Session settings every job in this package relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Wall-clock columns are zone-less; a session in any other zone would shift them.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs another shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # what a Python worker is handed at once, whatever the length of a row
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
# What a task reads, of files and of a shuffle; sorted rows take some ten times that in memory. A session that names them keeps its own.
TASK_CONF = {
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Task functions are pickled by reference, so a worker has to be able to import them
    wherever it was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    fd, name = tempfile.mkstemp(prefix=f"{PACKAGE.name}-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, str(Path(PACKAGE.name) / path.relative_to(PACKAGE)))
    spark.sparkContext.addPyFile(name)  # Spark copies it to the executors itself
    _shipped.add(app)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, value in TASK_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def build_session(app: str = "panelspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names in spark.checkpoint.dir.

    Only a local run may make its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named:
            context.setCheckpointDir(named)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return named or context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets later jobs read only the columns they need.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several later jobs and must survive lost executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

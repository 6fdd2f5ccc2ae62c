"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts come in batches of up to this many rows; ten thousand long ones would fill a worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Re-writing one repo or month must not drop the others.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the run-time settings the jobs rely on (results depend only on the UTC time zone)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    importable_by_workers(spark)
    return spark


def importable_by_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did (a cluster installs it)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hunkmill")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hunkmill-"))
    return context.getCheckpointDir()


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder now and read back from there.

    For tables that several steps read: they are computed once, survive lost executors, and their
    size is known.
    """
    spark = rows.sparkSession
    path = new_shared_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist; a missing source is skipped, not an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).globStatus(target):
            found.append(path)
    return found

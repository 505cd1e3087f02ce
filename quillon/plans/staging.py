"""Cutting lineage through tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Where it is unset (tests, a laptop)
a temporary folder is used, which is only right with a local master.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder for staged tables and files; never machine-local on a cluster."""
    global _LOCAL_ROOT
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _LOCAL_ROOT


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted when the JVM ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    jpath, fs = _handle(spark, path)
    fs.deleteOnExit(jpath)
    return path


def _handle(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    jpath, fs = _handle(spark, path)
    fs.delete(jpath, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    The scan survives lost executors, is read rather than recomputed by every
    consumer, and gives the planner true sizes for its join choices.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path  # type: ignore[attr-defined]
    return staged


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        drop_path(df.sparkSession, path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, whose session sends Python workers at most ``rows`` texts at a time.

    Spark's default of 10,000 rows is meant for numbers; of long texts it is many
    megabytes in the executor, again in the worker, and again on the way back. A
    size that the session names itself is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS) == "10000":
        conf.set(ARROW_ROWS, str(rows))
    return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has far fewer partitions than there are.

    One small file is otherwise one task. A table that is large beside the
    cluster has more partitions than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df

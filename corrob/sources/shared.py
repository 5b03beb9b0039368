"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a local session (tests) takes a new temporary folder and keeps it.

    On a cluster a folder of the driver's machine would be another one on each executor, so there it must be set.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-corrob-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _file(spark: SparkSession, at: str):
    """(file system, path) of ``at``, whatever its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, at: str) -> bool:
    """Whether there is a file or folder at ``at``."""
    files, path = _file(spark, at)
    return files.exists(path)


def modified(spark: SparkSession, at: str) -> int:
    """When the file or folder at ``at`` was last written; 0 where the store doesn't say."""
    files, path = _file(spark, at)
    return files.getFileStatus(path).getModificationTime() if files.exists(path) else 0


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/corrob-{name}-{uuid.uuid4().hex}"


def clear_at_exit(spark: SparkSession, at: str) -> None:
    """What has been written at ``at`` goes when the driver ends."""
    files, path = _file(spark, at)
    files.deleteOnExit(path)


def stash(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here, and lost executors cost nothing that is written.

    ``instead_of`` is an earlier stash that nothing but ``df`` needs any more; its files go once ``df`` is written.
    """
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.parquet(at)
    clear_at_exit(spark, at)
    if instead_of is not None:
        files, path = _file(spark, instead_of.stashed_at)
        files.delete(path, True)
    out = spark.read.schema(df.schema).parquet(at)
    out.stashed_at = at
    return out

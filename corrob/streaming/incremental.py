"""Structured Streaming jobs: snapshots, ledgers, weekly windows, changed rows only; ``imports`` has those that keep tables.

Each function takes a streaming (or batch) DataFrame; ``drain`` runs a stream over all that is there and stops. State
is bounded by watermarks. Sinks are Parquet files with a checkpoint, so a restarted job writes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrob.sources.shared import clear_at_exit, new_path


def stream_table(spark: SparkSession, folder: str, name: str, files: int | None = 4) -> DataFrame:
    """A table of the folder as a stream of ``files`` files a batch, by modification time; None: all in one batch.

    Backfills with a watermark take None: files needn't be in order of event time, and rows that come behind the
    watermark of an earlier batch are dropped.
    """
    at = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(at).schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/{name}.parquet*")


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All present input through the stream to Parquet files, read back."""
    spark = df.sparkSession
    out, ckpt = new_path(spark, name), new_path(spark, f"{name}-progress")
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).start(out).awaitTermination()
    clear_at_exit(spark, out), clear_at_exit(spark, ckpt)
    return spark.read.schema(df.schema).parquet(out)


def suppressed(df: DataFrame, count: str, messages: str, sources: str, least_messages: int, least_sources: int) -> DataFrame:
    """Counts only where messages and sources suffice; else null, with ``status``."""
    ok = (F.col(messages) >= least_messages) & (F.col(sources) >= least_sources)
    return df.withColumn("status", F.when(ok, "sufficient").otherwise("insufficient")).withColumn(count, F.when(ok, F.col(count)))


def hourly_snapshot(df: DataFrame, time: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """Latest value and record count of each closed hour."""
    w = df.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w")).agg(F.max_by(value, F.struct(time, value)).alias("latest"), F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("hour"), "latest", "n")


def weekly_rollup(df: DataFrame, time: str, keys: list[str], value: str, delay: str = "1 day") -> DataFrame:
    """Events and sums by closed 7-day window."""
    w = df.withWatermark(time, delay).groupBy(F.window(time, "7 days").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("week"), *keys, "n", "total")


def changed_only(new: DataFrame, published: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose content hash isn't the one published under their key."""
    digest = lambda df: df.withColumn("sha", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))
    return digest(new).join(digest(published).select(key, "sha"), [key, "sha"], "left_anti")

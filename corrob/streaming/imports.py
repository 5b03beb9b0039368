"""Imports that can be stopped anywhere: batches of a stream written in steps, each step once, finished on restart.

A batch writes its tables one after another into folders named by the stream and the batch. A folder is complete once
Spark's commit has marked it. A batch that runs again after a failure keeps the complete ones and goes on with the next,
so what was decided from earlier state isn't decided anew from state that has it already. Folders of a
table are read together; a new stream over the same state (another checkpoint, or another run) sees all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrob.sources.shared import exists
from corrob.streaming.summaries import Contract, judged


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, str], None]) -> None:
    """All present input through ``handle(batch, name)``; the name is that of the stream's checkpoint and the batch."""

    def each(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        handle(batch, f"{query}-{number:012d}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Table:
    """A folder with a folder of Parquet files for each batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def complete(self, batch: str) -> bool:
        return exists(self.spark, f"{self.path}/batch={batch}/_SUCCESS")

    def write(self, batch: str, df: DataFrame) -> bool:
        """Writes the batch, unless that is done; whether it was left to do."""
        if self.complete(batch):
            return False
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def read(self, without: str | None = None) -> DataFrame:
        """All rows with ``batch``; those of an incomplete batch that is being written can be left out."""
        schema = f"{self.schema}, batch string"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        return rows if without is None else rows.where(F.col("batch") != without)


def screen(stream: DataFrame, record: str, contract: Contract, state: str) -> tuple[Table, Table]:
    """One stream of summaries to two tables: accepted rows, and rejects with a row for every reason."""
    spark = stream.sparkSession
    columns = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    accepted, rejects = Table(spark, f"{state}/accepted", columns), Table(spark, f"{state}/rejects", f"{columns}, reason string")

    def handle(batch: DataFrame, name: str) -> None:
        seen = judged(batch, record, contract).persist()
        try:
            accepted.write(name, seen.where(F.size("reasons") == 0).drop("reasons"))
            rejects.write(name, seen.select(*stream.columns, F.explode("reasons").alias("reason")))
        finally:
            seen.unpersist()

    run_batches(stream, f"{state}/progress-screen", handle)
    return accepted, rejects


def import_snapshots(
    stream: DataFrame, key: str, record: Column, order: list[str], state: str, run: str = "run", before_receipts: Callable[[], None] = lambda: None
) -> tuple[Table, Table]:
    """Snapshots of records that differ from the current one of their key, and a receipt for each snapshot.

    The current record is the last that was imported. Records of a batch count in ``order``. A record with the hash of
    the one before it is no change and leaves no trace, as don't rows without key or record. The snapshot is the commit: on restart, a batch whose snapshots
    are complete only gets its receipts, marked ``recovered``; so do snapshots of earlier runs that were left without.
    ``run`` names the checkpoint; ``before_receipts`` is called between the two writes.
    """
    spark, kind = stream.sparkSession, dict(stream.dtypes)[key]
    told = f"`{key}` {kind}, sha256 string, place array<string>, imported_at timestamp"
    snapshots = Table(spark, f"{state}/snapshots", f"{told}, at int, record string")
    receipts = Table(spark, f"{state}/receipts", f"{told}, snapshot string, recovered boolean")

    def handle(batch: DataFrame, name: str) -> None:
        recovered = snapshots.complete(name)
        if not recovered:
            known = batch.where(F.col(key).isNotNull() & record.isNotNull())
            new = known.select(key, record.cast("string").alias("record"), *order, F.array(*(F.col(c).cast("string") for c in order)).alias("place"))
            new = new.withColumn("sha256", F.sha2("record", 256))
            earlier = snapshots.read(without=name).join(new.select(key).distinct(), key, "left_semi")
            current = earlier.groupBy(key).agg(F.max_by("sha256", F.struct("imported_at", "at")).alias("current"))
            inside = Window.partitionBy(key).orderBy(*order, "sha256")
            new = new.withColumn("before", F.lag("sha256").over(inside)).withColumn("at", F.row_number().over(inside)).join(current, key, "left")
            changed = ~F.col("sha256").eqNullSafe(F.coalesce("before", "current"))
            snapshots.write(name, new.where(changed).select(key, "sha256", "place", F.current_timestamp().alias("imported_at"), "at", "record"))
        before_receipts()
        if not receipts.complete(name):
            # Names of batches: a few for each run.
            done = F.broadcast(receipts.read(without=name).select(F.col("snapshot").alias("batch")).distinct())
            left = snapshots.read().join(done, "batch", "left_anti")
            late = F.when(F.col("batch") == name, F.lit(recovered)).otherwise(F.lit(True))
            receipts.write(name, left.select(key, "sha256", "place", F.current_timestamp().alias("imported_at"), F.col("batch").alias("snapshot"), late.alias("recovered")))

    run_batches(stream, f"{state}/progress-{run}", handle)
    return snapshots, receipts


def observe(stream: DataFrame, find: Callable[[DataFrame], DataFrame], state: str, run: str) -> tuple[Table, Table]:
    """Observations that no earlier batch or run made, and how many each batch made and suppressed.

    ``find`` makes observations with ``fingerprint`` of a batch. Fingerprints that the table of observations has, or that come twice in
    the batch, are suppressed. State is that table: it is joined, not held by the stream, and lasts from run to run.
    """
    spark = stream.sparkSession
    columns = ", ".join(f"`{c}` {t}" for c, t in find(spark.createDataFrame([], stream.schema)).dtypes)
    seen = Table(spark, f"{state}/observations", columns)
    counts = Table(spark, f"{state}/counts", "run string, found long, suppressed long")

    def handle(batch: DataFrame, name: str) -> None:
        found = find(batch).persist()
        try:
            known = seen.read(without=name).select("fingerprint").distinct()
            seen.write(name, found.dropDuplicates(["fingerprint"]).join(known, "fingerprint", "left_anti").select(*found.columns))
            kept = seen.read().where(F.col("batch") == name).agg(F.count(F.lit(1)).alias("kept"))
            counts.write(name, found.agg(F.count(F.lit(1)).alias("found")).join(kept).select(F.lit(run).alias("run"), "found", (F.col("found") - F.col("kept")).alias("suppressed")))  # one row each
        finally:
            found.unpersist()

    run_batches(stream, f"{state}/progress-{run}", handle)
    return seen, counts

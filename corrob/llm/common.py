"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrob.sources.shared import stash  # noqa: F401


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that column ``text`` (binary) of each part holds about ``most`` bytes; single rows stay whole."""
    for batch in batches:
        start = size = 0
        for i, value in enumerate(batch.column(text)):
            n = value.as_buffer().size if value.is_valid else 0
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it a column that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows that a Python worker gets at once, at most.
BATCH_ROWS = 1000


def utf8(column: str | Column) -> Column:
    """The UTF-8 bytes of a text column, so that workers need not decode it.

    Texts go to workers in batches of BATCH_ROWS at most (a lower setting of the session stays), besides the session's
    own limit in bytes: Spark's 10,000 would let long texts fill a worker's memory. Spark reads the setting when the
    query runs, so it stays changed in the session.
    """
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary")


def cells_for(largest: int, rows: int = 100_000) -> int:
    """Cells that a group of ``largest`` rows takes so that each has about ``rows``; 1,024 at least."""
    return max(1024, -(-largest // rows))


def ranked(df: DataFrame, groups: list[str], order: list[str], fine: int = 1024, name: str = "rank") -> DataFrame:
    """``df`` with column ``name``: 0, 1, … within each of ``groups``, without sorting a whole group in one task.

    Each group is split into ``fine`` cells by a hash of ``order``; cells are counted (with partial aggregation), the
    counts are summed up cell by cell, and only rows of one cell are sorted together. Rows that agree in ``order`` may
    swap ranks. ``groups`` must not be null.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(fine)).cast("int")
    rows = df.withColumn("__cell", cell)
    keys = [*groups, "__cell"]
    before = Window.partitionBy(*groups).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = rows.join(starts.select(*keys, "__before"), keys)
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return joined.withColumn(name, (F.col("__before") + inside).cast("long")).drop("__cell", "__before")


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, n: str = "n", least: int = 10_000) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``n`` how many of the ``total`` rows of ``left`` have it.

    Keys of more than a thousandth of all rows (and more than ``least``) are at most 1,000, so their side is broadcast and
    their rows stay where they are; all others are shuffled. ``n`` is dropped.
    """
    many = max(least, total // 1000)
    hot, rest = F.broadcast(right.where(F.col(n) > many).drop(n)), right.where(F.col(n) <= many).drop(n)
    return left.join(hot.select(key), key, "left_anti").join(rest, key).unionByName(left.join(hot, key))


def histogram_threshold(good: list[int], bad: list[int], most_good_lost: float) -> int | None:
    """The lowest bin from which on rows count as bad: best (share of bad found − share of good lost) under the limit.

    Where bins below it are empty, it moves down to the middle of them. ``good`` and ``bad`` count rows by bin, higher bins being worse. None where no bin helps (also without labels).
    """
    n_good, n_bad = sum(good), sum(bad)
    best, at, lost, found = 0.0, None, 0, 0
    for i in range(len(good) - 1, -1, -1):
        lost, found = lost + good[i], found + bad[i]
        if n_good and lost > most_good_lost * n_good:
            break
        gain = (found / n_bad if n_bad else 0.0) - (lost / n_good if n_good else 0.0)
        if gain > best:
            best, at = gain, i
    if at is None:
        return None
    below = next((i for i in range(at - 1, -1, -1) if good[i] or bad[i]), -1)
    return (at + below + 2) // 2

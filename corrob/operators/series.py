"""Time series that keep their gaps: densified trends, changes, indices, trajectories, staleness; ranks and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob.functions.columns import half_up
from corrob.sources.shared import stash


def densified(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """One row per key and reported time, 0 where a key has none. Times are a short axis, gathered to one small array."""
    each = stash(df.groupBy(*keys, time).agg(F.sum(value).alias("value")), "series")  # read three times below
    axis = each.select(F.explode(F.array(time)).alias(time)).distinct().agg(F.array_sort(F.collect_list(time)).alias("__axis"))
    spine = each.select(*keys).distinct().join(F.broadcast(axis), F.lit(True)).select(*keys, F.explode("__axis").alias(time))
    return spine.join(each, [*keys, time], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def latest_change(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Percent change between the two latest points; null with fewer or a previous of 0."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    two = df.withColumn("__rn", F.row_number().over(w)).withColumn("__prev", F.lead(value).over(w)).where("__rn = 1")
    return two.select(*keys, F.col(time).alias("latest"), F.when(F.col("__prev") != 0, half_up((F.col(value) - F.col("__prev")) / F.col("__prev") * 100, 1)).alias("change_pct"))


def rebased(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Index of the first point = 100, one decimal; null where the first isn't positive."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("index", F.when(first > 0, half_up(F.col(value) / first * 100, 1)))


def long_run_change(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """First against last reported point, for keys with at least two."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 2").withColumn("change_pct", F.when(F.col("first") > 0, half_up((F.col("last") - F.col("first")) / F.col("first") * 100, 1))).drop("n")


def trim_incomplete_tail(df: DataFrame, keys: list[str], time: str, value: str, least: float = 0.33) -> DataFrame:
    """Drops trailing points below ``least`` of the one before, up to the first stable one; two points stay."""
    w = Window.partitionBy(*keys).orderBy(time)
    marked = df.withColumns({"__rn": F.row_number().over(w), "__prev": F.lag(value).over(w)})
    stable = (F.col("__rn") <= 2) | (F.col(value) >= least * F.col("__prev"))
    last = F.max(F.when(stable, F.col("__rn"))).over(Window.partitionBy(*keys))
    return marked.withColumn("__last", last).where("__rn <= __last").drop("__rn", "__prev", "__last")


def group_trends(df: DataFrame, group: str, time: str, value: str) -> DataFrame:
    """Yearly series of each group, its change over the full axis; groups of zeros only are left out."""
    d = densified(df, [group], time, value)
    g = d.groupBy(group).agg(F.min_by("value", time).alias("first"), F.max_by("value", time).alias("last"), F.sum("value").alias("total"))
    return g.where("total > 0").withColumn("change_pct", F.when(F.col("first") > 0, half_up((F.col("last") - F.col("first")) / F.col("first") * 100, 1)))


def movers(df: DataFrame, keys: list[str], time: str, value: str, start: int, end: int, both: bool = False) -> DataFrame:
    """Totals at ``start`` and ``end``: missing counts as 0, or with ``both`` the key is left out."""
    at = lambda y: F.sum(F.when(F.col(time) == y, F.col(value)))
    g = df.where(F.col(time).isin(start, end)).groupBy(*keys).agg(at(start).alias("before"), at(end).alias("after"))
    g = g.where("before is not null and after is not null") if both else g.fillna(0, ["before", "after"])
    return g.withColumn("change", F.col("after") - F.col("before"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in a total order, with ``rank``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def trajectory(momentum: DataFrame, keys: list[str], time: str, value: str, at: int, band: float = 0.15) -> DataFrame:
    """Momentum at a time against the nearest earlier time with data: rising, falling, stable or insufficient-data."""
    g = momentum.where(F.col(time) <= at).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col(time) == at, F.col(value))), F.lit(0.0)).alias("current"), F.max(F.when(F.col(time) < at, F.col(time))).alias("baseline_year"),
        F.max_by(F.when(F.col(time) < at, F.col(value)), F.when(F.col(time) < at, F.col(time))).alias("baseline"),
    )
    change = (F.col("current") - F.col("baseline")) / F.col("baseline")
    word = F.when(F.col("baseline").isNull(), "insufficient-data").when(F.col("baseline") <= 0, F.when(F.col("current") > 0, "rising").otherwise("insufficient-data"))
    g = g.withColumn("trajectory", word.when(change > band, "rising").when(change < -band, "falling").otherwise("stable"))
    return g.withColumn("change_pct", F.when(F.col("baseline") > 0, half_up(change, 3))).select(*keys, "trajectory", "change_pct", "baseline_year")


def staleness(evidence: list[DataFrame], keys: list[str], time: str, at: int, aging: int = 1, stale: int = 3) -> DataFrame:
    """Latest evidence at or before a time over all sets, its age, and the tier."""
    all_ = evidence[0].select(*keys, time)
    for e in evidence[1:]:
        all_ = all_.unionByName(e.select(*keys, time))
    g = all_.where(F.col(time) <= at).groupBy(*keys).agg(F.max(time).alias("latest"))
    age = F.lit(at) - F.col("latest")
    return g.withColumn("age", age).withColumn("staleness", F.when(age >= stale, "stale").when(age >= aging, "aging").otherwise("current"))


def lookahead(lines: DataFrame, doc: str, pos: str, key: Column, value: Column, ahead: int = 2) -> DataFrame:
    """Each line with a key takes the first value on it or the next ``ahead`` lines, unless another key comes first."""
    w = Window.partitionBy(doc).orderBy(pos)
    marked = lines.withColumns({"__k": key, "__v": value})
    found = F.col("__v")
    open_ = F.lit(True)
    for i in range(1, ahead + 1):
        open_ = open_ & F.lead("__k", i).over(w).isNull()
        found = F.coalesce(found, F.when(open_, F.lead("__v", i).over(w)))
    return marked.withColumn("__found", found).where("__k is not null and __found is not null").select(doc, F.col("__k").alias("key"), F.col("__found").alias("value")).distinct()

"""Aggregations over published records: totals, concentration, chokepoints, coverage, provenance-aware sums.

Every function takes DataFrames and column names and returns a DataFrame; sums are partial before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob.functions.columns import clamp, half_up, half_up_int, round_sig


def totals_by(df: DataFrame, keys: list[str], value: str, where: Column | None = None, name: str = "total") -> DataFrame:
    return (df.where(where) if where is not None else df).groupBy(*keys).agg(F.sum(value).alias(name))


def max_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The largest of the totals by ``keys``: a scale that fits all of them; 0 over nothing."""
    return totals_by(df, keys, value).agg(F.coalesce(F.max("total"), F.lit(0)).alias("most"))


def groups_by_volume(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Totals of all groups of ``dim``, zero where nothing was reported."""
    return dim.select(key).distinct().join(totals_by(df, [key], value), key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"))


def mean_with_coverage(df: DataFrame, keys: list[str], value: str, period: str, digits: int = 6) -> DataFrame:
    """Mean over periods to ``digits`` significant digits, and how many periods it rests on."""
    return df.groupBy(*keys).agg(round_sig(F.avg(value), digits).alias("mean"), F.countDistinct(period).alias("observed"))


def event_intensity(df: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Count and weight of events to one figure from 5 to 100 on a logarithmic scale."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.sum(weight).alias("weight"))
    return agg.withColumn("intensity", clamp(half_up(14 * F.log1p(F.col("events").cast("double")) + 9 * F.log1p(F.col("weight").cast("double"))), 5, 100).cast("long"))


def relative_burden(df: DataFrame, keys: list[str], burden: Column) -> DataFrame:
    """Burden by ``keys`` as a share (0 to 100) of the largest, logarithmic. The maximum is one number, joined back."""
    agg = df.groupBy(*keys).agg(F.sum(burden).alias("burden"))
    most = agg.agg(F.max("burden").alias("__most"))
    out = agg.join(F.broadcast(most), F.lit(True))  # one row
    return out.withColumn("intensity", F.when(F.col("__most") > 0, half_up(100 * F.log1p(F.col("burden").cast("double")) / F.log1p(F.col("__most").cast("double")))).otherwise(0.0).cast("long")).drop("__most")


def histograms(df: DataFrame, keys: list[str]) -> DataFrame:
    """Independent counts by each of ``keys`` in one pass: dimension, key, records. Null keys are left out."""
    view = df.select(*(F.col(k).cast("string").alias(k) for k in keys))
    sets = view.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(F.count(F.lit(1)).alias("records"), F.grouping_id().alias("g"))
    which = F.element_at(F.array(*(F.lit(k) for k in keys)), F.lit(len(keys)) - F.round(F.log2((F.lit(2 ** len(keys) - 1) - F.col("g")).cast("double"))).cast("int"))
    return sets.select(which.alias("dimension"), F.coalesce(*keys).alias("key"), "records").where("key is not null")


def hhi(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Herfindahl index (0 to 10,000), dominant key and its share; null where the total isn't positive. Ties: least key."""
    each = df.groupBy(*by, key).agg(F.sum(value).alias("v"))
    whole = Window.partitionBy(*by)
    share = each.withColumn("total", F.sum("v").over(whole)).withColumn("share", F.when(F.col("total") > 0, F.col("v") / F.col("total")))
    best = F.min_by(key, F.struct(-F.col("v"), F.col(key)))
    return share.groupBy(*by).agg(
        # Σv²·10,000/total², with one division: whole numbers sum up exactly in any order.
        half_up_int(F.when(F.max("total") > 0, F.sum(F.col("v") * F.col("v")) * 10_000.0 / (F.max("total") * F.max("total")))).alias("hhi"), F.when(F.max("total") > 0, best).alias("dominant"),
        half_up(F.max("share") * 100, 1).alias("dominant_share"), F.count(F.lit(1)).alias("n_keys"),
    )


def concentration_tier(index: Column) -> Column:
    return F.when(index.isNull(), "insufficient-data").when(index > 2500, "concentrated").when(index >= 1500, "moderate").otherwise("diversified")


def chokepoints(df: DataFrame, node: str, feeder: str, value: str, least_feeders: int = 2, least_share: float = 40.0) -> DataFrame:
    """Per exit node: quantity, different feeders, share of the network; systemic by either limit."""
    each = df.groupBy(node).agg(F.sum(value).alias("quantity"), F.countDistinct(feeder).alias("feeders"))
    all_ = each.agg(F.sum("quantity").alias("__all"))
    out = each.join(F.broadcast(all_), F.lit(True)).where("__all > 0")  # one row
    out = out.withColumn("share_pct", half_up(F.col("quantity") / F.col("__all") * 100, 1)).drop("__all")
    return out.withColumn("systemic", (F.col("feeders") >= least_feeders) | (F.col("share_pct") >= least_share))


def summable(relation="quantity_relation", kind="record_kind", eligible="eligibility", group="aggregation_group") -> Column:
    """Rows whose quantities may be added: exact, of a known kind, not derived, eligible, in a named group."""
    return F.coalesce((F.col(relation) == "exact") & F.col(kind).isNotNull() & (F.col(kind) != "derived") & (F.col(eligible) == "eligible") & F.col(group).isNotNull(), F.lit(False))


def flow_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Eligible and excluded rows, groups, and a subtotal only where one group is left."""
    ok = summable()
    return df.groupBy(*keys).agg(
        F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("excluded"), F.countDistinct(F.when(ok, F.col("aggregation_group"))).alias("groups"),
        F.sum(F.when(ok, F.col(value))).alias("__s"),
    ).withColumn("subtotal", F.when(F.col("groups") == 1, F.col("__s"))).drop("__s")


def aggregation_status(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Why a quantity is or isn't given: no records, nothing exact, nothing eligible, mixed groups, computed."""
    ok, exact = summable(), F.coalesce(F.col("quantity_relation") == "exact", F.lit(False))
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.count_if(exact).alias("exact"), F.count_if(ok).alias("eligible"), F.countDistinct(F.when(ok, F.col("aggregation_group"))).alias("groups"), F.sum(F.when(ok, F.col(value))).alias("__s"))
    status = F.when(F.col("records") == 0, "no-records").when(F.col("exact") == 0, "non-exact-only").when(F.col("eligible") == 0, "exact-ineligible").when(F.col("groups") > 1, "mixed-groups").otherwise("computed")
    return agg.withColumn("status", status).withColumn("quantity", F.when(F.col("status") == "computed", F.col("__s"))).drop("__s")


def element_counts(df: DataFrame, array: str, n: int | None = None) -> DataFrame:
    """Rows by element of an array column (each element once a row), most first and then by name."""
    out = df.select(F.explode(F.array_distinct(array)).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    return out if n is None else out.orderBy(F.desc("n"), "element").limit(n)


def scope_partition(df: DataFrame, programs: str, first: list[str], second: list[str]) -> DataFrame:
    """How two program sets part the entities: specific to the first, only in the second, and whether that is all."""
    a = F.arrays_overlap(F.col(programs), F.array(*map(F.lit, first)))
    b = F.arrays_overlap(F.col(programs), F.array(*map(F.lit, second)))
    agg = df.agg(F.count_if(a | b).alias("scope"), F.count_if(a).alias("specific"), F.count_if(~a & b).alias("second_only"), F.count_if((a | b) & (F.size("countries") >= 2)).alias("multi_country"))
    return agg.withColumn("partitions", F.col("scope") == F.col("specific") + F.col("second_only"))


def peak(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Largest value and its first time, the latest value, and the change from the peak."""
    out = df.groupBy(*keys).agg(F.min_by(time, F.struct(-F.col(value), F.col(time))).alias("peak_time"), F.max(value).alias("peak_value"), F.max_by(value, time).alias("latest"))
    return out.withColumn("from_peak", F.when(F.col("peak_value") > 0, half_up((F.col("latest") - F.col("peak_value")) / F.col("peak_value"), 3)))


def latest_non_null(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(time).alias("at"), F.max_by(value, time).alias("value"))


def node_records(df: DataFrame, record: str, roles: list[str]) -> DataFrame:
    """Different records that touch a node in any role, and in which roles; quantities are never summed."""
    touched = df.select(record, F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("node")) for r in roles))).alias("t")).where("t.node is not null")
    return touched.groupBy(F.col("t.node").alias("node")).agg(F.countDistinct(record).alias("records"), *(F.bool_or(F.col("t.role") == r).alias(f"is_{r}") for r in roles))


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """Share of rows with a value, per field: one pass, then one row per field."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    one = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(has(c)).alias(c) for c in fields))
    kinds = dict(df.dtypes)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("type"), F.col(c).alias("present")) for c in fields)))
    return one.select(rows.alias("r"), "__n").select("r.field", "r.type", "r.present", F.when(F.col("__n") > 0, half_up(F.col("r.present") / F.col("__n"), 4)).alias("share"))


def price_contrast(df: DataFrame, keys: list[str], name: str, time: str, value: str) -> DataFrame:
    """Cheapest and dearest of the latest year with at least two rows there, else of all years."""
    last = df.withColumn("__last", F.max(time).over(Window.partitionBy(*keys)))
    last = last.withColumn("__in", F.count_if(F.col(time) == F.col("__last")).over(Window.partitionBy(*keys)))
    kept = last.where((F.col("__in") < 2) | (F.col(time) == F.col("__last")))
    low, high = F.struct(F.col(value), F.col(name), F.col(time)), F.struct(-F.col(value), F.col(name), F.col(time))
    return kept.groupBy(*keys).agg(F.min_by(name, low).alias("cheapest"), F.min(value).alias("low"), F.min_by(name, high).alias("dearest"), F.max(value).alias("high"))


def share_of(df: DataFrame, keys: list[str], value: str, where: Column) -> DataFrame:
    """Share (percent) of the total of ``value`` on rows that meet a condition; null over nothing."""
    s = df.groupBy(*keys).agg(F.sum(value).alias("total"), F.coalesce(F.sum(F.when(where, F.col(value))), F.lit(0)).alias("part"))
    return s.withColumn("share_pct", F.when(F.col("total") > 0, half_up(F.col("part") / F.col("total") * 100, 1)))

"""Regional risk from many sources: pressures, score, confidence, disagreement, leave-one-family-out, spillover.

Inputs are evidence tables of all years with ``region``, ``year`` and, but for statistics, ``source_name``,
``source_url``, ``family`` and ``reliability``; ``conflicts`` also actor, kind, intensity; ``inflows`` origin, product,
qty, weighted; ``outflows`` corridor, product, qty; ``stats`` ha, index. Everything is aggregated by region before it
meets the spine, so joins are between tables with a row per region.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.functions.columns import clamp, half_up, half_up_int
from corrob.operators import series
from corrob.operators.aggregate import concentration_tier, hhi
from corrob.sources.shared import stash

# Weights of the score, in the order of the pressures.
WEIGHTS = (("conflict", 0.25, "conflict pressure"), ("inflow", 0.25, "inbound precursor pressure"), ("outflow", 0.2, "seized outbound flow"), ("activity", 0.2, "synthetic-drug activity"), ("opium", 0.1, "opium cultivation"))


@dataclass(frozen=True)
class RiskParams:
    """high: score of high risk; gap: to a neighbor that makes a watch; deviation: of values that disagree."""

    high: int = 70
    gap: int = 15
    deviation: float = 0.5
    conflict_penalty: float = 15.0
    stale_penalty: float = 12.0
    aging_penalty: float = 4.0


@dataclass(frozen=True)
class Evidence:
    regions: DataFrame
    stats: DataFrame
    conflicts: DataFrame
    inflows: DataFrame
    outflows: DataFrame
    adjacency: DataFrame

    def of(self, year: int) -> Evidence:
        at = lambda df: df.where(F.col("year") == year)
        return Evidence(self.regions, at(self.stats), at(self.conflicts), at(self.inflows), at(self.outflows), self.adjacency)


def share(value: Column, most: Column) -> Column:
    return F.when(most > 0, value / most * 100).otherwise(0.0)


def score(conflict: Column, inflow: Column, outflow: Column, activity: Column, opium: Column) -> Column:
    w = [x for _, x, _ in WEIGHTS]
    return clamp(conflict * w[0] + inflow * w[1] + outflow * w[2] + activity * w[3] + opium * w[4], 0.0, 100.0)


def pressures(e: Evidence) -> DataFrame:
    """One row per region of the spine: raw sums, pressures of 0 to 100, the score, and counts. ``e`` is of one year."""
    c = e.conflicts.groupBy("region").agg(F.max("intensity").alias("c"), F.count(F.lit(1)).alias("nc"))
    i = e.inflows.groupBy("region").agg(F.sum("weighted").alias("in_sum"), F.count(F.lit(1)).alias("ni"))
    o = e.outflows.groupBy("region").agg(F.sum("qty").alias("out_sum"), F.count(F.lit(1)).alias("no"))
    s = e.stats.groupBy("region").agg(F.first("ha").alias("ha"), F.first("index").alias("index"))
    most = i.agg(F.greatest(F.coalesce(F.max("in_sum"), F.lit(0)), F.lit(0)).alias("max_in"))
    most = most.join(o.agg(F.greatest(F.coalesce(F.max("out_sum"), F.lit(0)), F.lit(0)).alias("max_out")), F.lit(True))
    most = most.join(s.agg(F.greatest(F.coalesce(F.max("ha"), F.lit(0)), F.lit(0)).alias("max_ha")), F.lit(True))
    p = e.regions.join(c, "region", "left").join(i, "region", "left").join(o, "region", "left").join(s, "region", "left").join(F.broadcast(most), F.lit(True))  # one row
    n = lambda x: F.coalesce(x, F.lit(0))
    p = p.withColumn("has_stat", F.col("ha").isNotNull()).withColumns({"in_sum": n("in_sum").cast("double"), "out_sum": n("out_sum"), "ha": n("ha")})
    p = p.withColumns({
        "conflict": n("c").cast("double"), "inflow": share(F.col("in_sum"), F.col("max_in")), "outflow": share(F.col("out_sum"), F.col("max_out")), "activity": n("index").cast("double"),
        "opium": share(F.col("ha"), F.col("max_ha")), "evidence": n("nc") + n("ni") + n("no") + F.col("has_stat").cast("int"),
    })
    p = p.withColumn("raw_score", score(*(F.col(k) for k, _, _ in WEIGHTS)))
    return p.withColumn("risk_score", half_up_int(F.col("raw_score"))).drop("c", "nc", "ni", "no", "index")


def drivers() -> Column:
    """The labels of the three strongest pressures, declared order on ties."""
    rows = F.array(*(F.struct((-F.col(k)).alias("v"), F.lit(i).alias("i"), F.lit(label).alias("l")) for i, (k, _, label) in enumerate(WEIGHTS)))
    return F.transform(F.slice(F.array_sort(rows), 1, 3), lambda x: x["l"])


def source_diversity(e: Evidence) -> DataFrame:
    """Per region: families, different names, mean reliability of the names. Unattributed rows aren't sources."""
    cols = ["region", "source_name", "family", "reliability"]
    u = e.conflicts.select(*cols).unionByName(e.inflows.select(*cols)).unionByName(e.outflows.select(*cols)).where("source_name is not null").distinct()
    g = u.groupBy("region").agg(F.countDistinct("family").alias("source_diversity"), F.countDistinct("source_name").alias("raw_names"), F.avg("reliability").alias("reliability"))
    return g.withColumn("verification", F.when(F.col("source_diversity") >= 2, "multi-source").when(F.col("source_diversity") == 1, "single-source").otherwise("unverified"))


def disagreement(df: DataFrame, keys: list[str], value: str, p: RiskParams = RiskParams()) -> DataFrame:
    """Groups of at least two families whose values are too far from their reliability-weighted mean.

    The farthest value is the largest or the least one, so no value meets its mean in a join.
    """
    v, w = F.col(value), F.col("reliability")
    g = df.where("source_name is not null").groupBy(*keys).agg(F.countDistinct("family").alias("families"), (F.sum(v * w) / F.sum(w)).alias("mean"), F.max(v).alias("hi"), F.min(v).alias("lo"))
    far = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) / F.col("mean")
    g = g.where((F.col("families") >= 2) & (F.col("mean") > 0)).withColumn("deviation", far).where(F.col("deviation") > p.deviation)
    return g.select(*keys, "families", half_up(F.col("mean"), 2).alias("mean"), half_up_int(F.col("deviation") * 100).alias("deviation_pct"))


def conflict_notes(e: Evidence, p: RiskParams = RiskParams()) -> DataFrame:
    """region, set, key, families, deviation_pct: disagreements of inflows, events and attributed outflows."""
    parts = [(e.inflows, "inflow", "product", "qty"), (e.conflicts, "event", "kind", "intensity"), (e.outflows, "outflow", "product", "qty")]
    out = None
    for df, name, key, value in parts:
        d = disagreement(df, ["region", key], value, p).select("region", F.lit(name).alias("set"), F.col(key).alias("key"), "families", "deviation_pct")
        out = d if out is None else out.unionByName(d)
    return out


def notes_by_region(notes: DataFrame) -> DataFrame:
    """One list of notes per region; as many as its products and kinds of events at most."""
    text = F.format_string("%s %s: %d source families, %d%% from their mean", "set", "key", "families", "deviation_pct")
    order = F.when(F.col("set") == "inflow", 1).when(F.col("set") == "event", 2).otherwise(3)
    g = notes.groupBy("region").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "key", text.alias("t")))).alias("n"))
    return g.select("region", F.transform("n", lambda x: x["t"]).alias("notes"))


def fragility(base: DataFrame, e: Evidence, p: RiskParams = RiskParams()) -> DataFrame:
    """Regions of high risk that fall below it without one source family: region, fragile, family, drop.

    Each family's part of the sums is known, so leaving it out is a subtraction. Ties: the first family by name.
    """
    i = e.inflows.groupBy("region", "family").agg(F.sum("weighted").alias("i"))
    o = e.outflows.where("source_name is not null").groupBy("region", "family").agg(F.sum("qty").alias("o"))
    parts = i.join(o, ["region", "family"], "full").fillna(0, ["i", "o"])
    x = base.where(F.col("risk_score") >= p.high).join(parts, "region")
    without = score(F.col("conflict"), share(F.col("in_sum") - F.col("i"), F.col("max_in")), share(F.col("out_sum") - F.col("o"), F.col("max_out")), F.col("activity"), F.col("opium"))
    worst = x.withColumn("w", without).where("w < risk_score").groupBy("region", "risk_score").agg(F.min("w").alias("w"), F.min_by("family", F.struct("w", "family")).alias("family"))
    fell = half_up_int(F.col("w"))
    return worst.where(fell < p.high).select("region", F.lit(True).alias("fragile"), "family", (F.col("risk_score") - fell).alias("drop"))


def watch(own: Column, other: Column, p: RiskParams) -> Column:
    return (other >= p.high) & (own < p.high) & (other - own >= p.gap)


def spillover(scores: DataFrame, adjacency: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """Highest neighbor per region and whether it makes a watch. ``scores``: region, risk_score."""
    near = adjacency.join(scores.select(F.col("region").alias("neighbor"), F.col("risk_score").alias("s")), "neighbor").where("s > 0")
    top = near.groupBy("region").agg(F.max("s").alias("neighbor_score"), F.min_by("neighbor", F.struct(-F.col("s"), "neighbor")).alias("neighbor"))
    out = scores.select("region", "risk_score").join(top, "region", "left").withColumn("neighbor_score", F.coalesce("neighbor_score", F.lit(0)))
    return out.withColumn("spillover_watch", watch(F.col("risk_score"), F.col("neighbor_score"), p)).drop("risk_score")


def actor_network(scores: DataFrame, conflicts: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """Highest other region that shares an actor. Per actor only its two highest regions matter, so pairs of regions
    that share an actor are never listed."""
    shared = conflicts.select("region", "actor").distinct().join(scores.select("region", "risk_score"), "region").where("actor is not null")
    key = lambda: F.struct((-F.col("risk_score")).alias("s"), F.col("region").alias("r"))
    first = shared.groupBy("actor").agg(F.min(key()).alias("a"))
    second = shared.join(first, "actor").where("region <> a.r").groupBy("actor", "a").agg(F.min(key()).alias("b"))
    best = F.when(F.col("region") != F.col("a.r"), F.col("a")).otherwise(F.col("b"))
    each = shared.join(second, "actor").select("region", "actor", best.alias("o")).where("o.s < 0")
    top = each.groupBy("region").agg(F.min(F.struct("o.s", "o.r", "actor")).alias("t"))
    out = scores.select("region", "risk_score").join(top, "region", "left")
    out = out.select("region", "risk_score", F.coalesce(-F.col("t.s"), F.lit(0)).alias("actor_score"), F.col("t.r").alias("actor_region"), F.col("t.actor").alias("actor"))
    return out.withColumn("actor_watch", watch(F.col("risk_score"), F.col("actor_score"), p)).drop("risk_score")


def momentum(e: Evidence) -> DataFrame:
    a = e.stats.select("region", "year", (F.col("ha") * 0.01 + F.col("index") * 10).alias("m"))
    return a.unionByName(e.outflows.select("region", "year", (F.col("qty") * 0.1).alias("m"))).groupBy("region", "year").agg(F.sum("m").alias("m"))


def with_confidence(base: DataFrame, e: Evidence, year: int, p: RiskParams = RiskParams()) -> DataFrame:
    """``base`` (pressures of the year) with source diversity, notes, staleness and the confidence score."""
    now = e.of(year)
    stale = series.staleness([e.stats, e.conflicts, e.inflows, e.outflows], ["region"], "year", year)
    b = base.join(source_diversity(now), "region", "left").fillna(0, ["source_diversity", "raw_names", "reliability"]).fillna("unverified", ["verification"])
    b = b.join(notes_by_region(conflict_notes(now, p)), "region", "left").join(stale, "region", "left").fillna("no-data", ["staleness"])
    penalty = F.when(F.col("staleness") == "stale", p.stale_penalty).when(F.col("staleness") == "aging", p.aging_penalty).otherwise(0.0)
    b = b.withColumn("has_conflict", F.col("notes").isNotNull())
    confidence = (
        F.least(F.lit(100), F.col("evidence") * 16) * 0.45 + F.least(F.lit(100), F.col("source_diversity") * 34) * 0.35 * (0.5 + 0.5 * F.col("reliability"))
        + F.when(F.col("has_stat"), 20.0).otherwise(0.0) - F.when(F.col("has_conflict"), p.conflict_penalty).otherwise(0.0) - penalty
    )
    return b.withColumn("confidence_score", half_up_int(clamp(confidence, 0.0, 100.0)))


def corridors(regions: DataFrame, e: Evidence) -> DataFrame:
    """Per region: concentration, tier, dominant side and its share, of inflows and of outflows. ``e`` is of one year."""
    out = regions.select("region")
    for side, df, key in (("inflow", e.inflows, "origin"), ("outflow", e.outflows, "corridor")):
        h = hhi(df, ["region"], key, "qty").select("region", F.col("hhi").alias(f"{side}_hhi"), F.col("dominant").alias(f"{side}_dominant"), F.col("dominant_share").alias(f"{side}_share"))
        out = out.join(h, "region", "left").withColumn(f"{side}_tier", concentration_tier(F.col(f"{side}_hhi")))
    return out


def watches(scores: DataFrame, e: Evidence, p: RiskParams = RiskParams()) -> DataFrame:
    """Spillover and actor watches per region, and whether both warn. ``e`` is of one year."""
    both = spillover(scores, e.adjacency, p).join(actor_network(scores, e.conflicts, p), "region")
    return both.withColumn("compound_warning", F.col("spillover_watch") & F.col("actor_watch"))


def risk_briefing(e: Evidence, year: int, p: RiskParams = RiskParams()) -> DataFrame:
    """The whole briefing: one row per region."""
    now = e.of(year)
    base = stash(pressures(now), "pressures")  # a row per region, which every part below starts from
    b = with_confidence(base, e, year, p).join(corridors(e.regions, now), "region")
    b = b.join(series.trajectory(momentum(e), ["region"], "year", "m", year), "region", "left").fillna("insufficient-data", ["trajectory"])
    b = b.join(fragility(base, now, p).withColumnRenamed("family", "fragile_family").withColumnRenamed("drop", "fragile_drop"), "region", "left").fillna(False, ["fragile"])
    b = b.join(watches(base.select("region", "risk_score"), now, p), "region")
    return b.select(
        "region", F.lit(year).alias("year"), "risk_score", "confidence_score", "source_diversity", "raw_names", "evidence", *(half_up_int(F.col(k)).alias(k) for k in ("conflict", "inflow", "outflow", "activity")), "ha",
        F.array_join(drivers(), ", ").alias("drivers"), "verification", "has_conflict", F.array_join(F.coalesce("notes", F.array().cast("array<string>")), "; ").alias("notes"), half_up(F.col("reliability"), 2).alias("reliability"),
        "trajectory", "change_pct", "baseline_year", "latest", "age", "staleness", "inflow_hhi", "inflow_tier", "inflow_dominant", "inflow_share", "outflow_hhi", "outflow_tier", "outflow_dominant", "outflow_share",
        "fragile", "fragile_family", "fragile_drop", "neighbor", "neighbor_score", "spillover_watch", "actor", "actor_region", "actor_score", "actor_watch", "compound_warning",
    )


def readiness(b: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """Counts over the briefing, in one aggregation."""
    c = F.count_if
    return b.agg(
        half_up_int(F.coalesce(c((F.col("evidence") > 1) & (F.col("source_diversity") > 0)) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, F.lit(0.0))).alias("provenance_pct"),
        c(F.col("source_diversity") >= 2).alias("multi_source"), c(F.col("risk_score") >= p.high).alias("high_risk"), F.sum("evidence").alias("evidence"), c("has_conflict").alias("conflicted"),
        c(F.col("trajectory") == "rising").alias("rising"), c("spillover_watch").alias("spillover"), c(F.col("staleness") == "stale").alias("stale"), c(F.col("inflow_tier") == "concentrated").alias("concentrated_in"),
        c(F.col("outflow_tier") == "concentrated").alias("concentrated_out"), c(F.col("raw_names") > F.col("source_diversity")).alias("duplicate_names"), c("actor_watch").alias("actor_network"),
        c("fragile").alias("single_source_fragile"), c("compound_warning").alias("compound"),
    )

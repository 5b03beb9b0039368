"""Comparison of supply and demand indicators: readings, verdicts, robustness, caveats, ranked divergences.

A reading says for a (country, product) and modality whether a change between two years is known, its size, and why
not if unknown. Each modality is aggregated once for all pairs; verdicts are column expressions over one row a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.functions.columns import half_up

# Modalities in order, their side of the market and who collects them; verdicts that diverge.
MODALITIES = (("seizures", "supply", "enforcement"), ("retail_price", "supply", "price-survey"), ("mortality", "demand", "vital-statistics"), ("wastewater", "demand", "laboratory"))
DIVERGENT = ("enforcementArtifact", "undetectedExpansion", "mixedSignals")


@dataclass(frozen=True)
class TriangulationParams:
    band: float = 0.15
    least_collectors: int = 2


def relative_change(current: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (current - baseline) / baseline)


def direction(change: Column, band: float = 0.15) -> Column:
    return F.when(change > band, 1).when(change < -band, -1).otherwise(0)


def readings(pairs: DataFrame, modality: str, values: DataFrame, now: int, before: int, covered: DataFrame | None = None, zero_is_absent: bool = False) -> DataFrame:
    """country, product, modality, available, current, baseline, change, reason for all ``pairs``.

    ``values``: country, product, year, v. ``covered``: countries that the modality reports at all (else any).
    Reasons, first that holds: country not covered (with those that are), product absent, year absent.
    """
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("v"))).cast("double")
    g = values.groupBy("country", "product").agg(at(now).alias("current"), at(before).alias("baseline"))
    out = pairs.join(g.withColumn("__seen", F.lit(True)), ["country", "product"], "left")
    if zero_is_absent:  # nothing reported at either time counts as zero, and both zero as no reading
        out = out.withColumns({"current": F.coalesce("current", F.lit(0.0)), "baseline": F.coalesce("baseline", F.lit(0.0))})
        ok = (F.col("current") > 0) | (F.col("baseline") > 0)
    else:
        ok = F.col("current").isNotNull() & F.col("baseline").isNotNull()
    reason = F.when(F.col("__seen").isNull(), "product not reported").otherwise("year not reported")
    if covered is not None:
        # One row; the list of covered countries is as short as the reporters of one modality.
        names = covered.select("country").distinct().agg(F.array_join(F.array_sort(F.collect_set("country")), ", ").alias("__names"))
        out = out.join(covered.select("country").distinct().withColumn("__in", F.lit(True)), "country", "left").join(F.broadcast(names), F.lit(True))
        reason = F.when(F.col("__in").isNull(), F.concat(F.lit("country not covered (covered: "), "__names", F.lit(")"))).otherwise(reason)
    ok = F.coalesce(ok, F.lit(False))
    return out.select("country", "product", F.lit(modality).alias("modality"), ok.alias("available"), F.when(ok, F.col("current")).alias("current"), F.when(ok, F.col("baseline")).alias("baseline"), F.when(ok, relative_change(F.col("current"), F.col("baseline"))).alias("change"), F.when(~ok, reason).alias("reason"))


def wide(all_readings: DataFrame) -> DataFrame:
    """One row per pair: on_<modality> and ch_<modality>."""
    aggs = []
    for m, _, _ in MODALITIES:
        aggs += [F.bool_or(F.when(F.col("modality") == m, F.col("available")).otherwise(False)).alias(f"on_{m}"), F.max(F.when(F.col("modality") == m, F.col("change"))).alias(f"ch_{m}")]
    return all_readings.groupBy("country", "product").agg(*aggs)


def _sides(drop: str | None, p: TriangulationParams) -> tuple[Column, Column, Column, Column, Column]:
    on = {m: F.lit(False) if m == drop else F.col(f"on_{m}") for m, _, _ in MODALITIES}
    d = {m: direction(F.col(f"ch_{m}"), p.band) for m, _, _ in MODALITIES}
    supply = F.when(on["seizures"], d["seizures"]).when(on["retail_price"], -d["retail_price"]).otherwise(0)
    demand = F.when(on["wastewater"], d["wastewater"]).when(on["mortality"], d["mortality"]).otherwise(0)
    collectors = sum((on[m].cast("int") for m, _, _ in MODALITIES), F.lit(0))  # each modality has a collector of its own
    return supply, demand, on["seizures"] | on["retail_price"], on["mortality"] | on["wastewater"], collectors


def verdict(drop: str | None = None, p: TriangulationParams = TriangulationParams()) -> Column:
    """The verdict over ``wide`` columns, with one modality left out if named."""
    s, d, has_s, has_d, n = _sides(drop, p)
    return (
        F.when(~has_s | ~has_d | (n < p.least_collectors), "untriangulated").when((s == 1) & (d == 1), "concordantExpansion").when((s == -1) & (d == -1), "concordantContraction")
        .when((s == 1) & (d <= 0), "enforcementArtifact").when((s <= 0) & (d == 1), "undetectedExpansion").when((s == 0) & (d == 0), "concordantContraction").otherwise("mixedSignals")
    )


def triangulate(w: DataFrame, p: TriangulationParams = TriangulationParams()) -> DataFrame:
    """Verdict, directions, coverage, the first modality whose loss gives another verdict, conflicts of supply signals."""
    out = w.withColumn("verdict", verdict(None, p))
    fragile = F.lit(None).cast("string")
    for m, _, _ in reversed(MODALITIES):
        v = verdict(m, p)
        fragile = F.when(F.col(f"on_{m}") & (v != F.col("verdict")) & (v != "untriangulated"), m).otherwise(fragile)
    s, d, _, _, n = _sides(None, p)
    a, b = direction(F.col("ch_seizures"), p.band), -direction(F.col("ch_retail_price"), p.band)
    out = out.withColumns({
        "supply": s, "demand": d, "collectors": n, "fragile_modality": F.when(F.col("verdict") != "untriangulated", fragile),
        "supply_conflict": F.col("on_seizures") & F.col("on_retail_price") & (a != 0) & (b != 0) & (a != b),
    })
    return out.withColumns({"fragile": F.col("fragile_modality").isNotNull(), "minimum_coverage": (F.col("verdict") != "untriangulated") & (F.col("collectors") == p.least_collectors)})


def caveats(bridge: Column) -> Column:
    """Ordered caveats of a triangulated row; ``bridge`` is the vocabulary's own, or null."""
    return F.array_compact(F.array(
        bridge, F.when(F.col("supply_conflict"), "supply signals disagree"), F.when(F.col("fragile"), F.concat(F.lit("not robust without "), "fragile_modality")),
        F.when(F.col("minimum_coverage"), "two collectors only"),
    ))


def scan_divergences(t: DataFrame) -> DataFrame:
    """Triangulated pairs with the gap between supply and demand; divergent verdicts first, then the widest gap."""
    supply = F.when(F.col("on_seizures"), F.col("ch_seizures")).otherwise(-F.col("ch_retail_price"))
    demand = F.when(F.col("on_wastewater"), F.col("ch_wastewater")).otherwise(F.col("ch_mortality"))
    out = t.where("verdict <> 'untriangulated'").withColumn("gap", half_up(F.abs(F.coalesce(supply, F.lit(0.0)) - F.coalesce(demand, F.lit(0.0))), 3))
    return out.withColumn("divergent", F.col("verdict").isin(*DIVERGENT)).orderBy(F.desc("divergent"), F.desc("gap"), "country", "product")

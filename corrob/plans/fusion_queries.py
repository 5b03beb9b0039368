"""Queries of evidence fusion (R) and the joins it rests on (J8, J10, J11)."""

from pyspark.sql import functions as F

from corrob.functions.columns import half_up
from corrob.operators import aggregate as A
from corrob.operators import fusion as R
from corrob.plans import views as V
from corrob.plans.registry import query
from corrob.plans.series_queries import MOMENTUM, TRAJECTORY
from corrob.sources.shared import stash

YEAR = 2000
#: Derived evidence spreads scores less than real records do, so the limits of the watches are lower here.
P = R.RiskParams(high=65, gap=8)


def evidence(spark, d) -> R.Evidence:
    """Evidence tables up to YEAR; each is aggregated or selected and written once, as the briefing reads them many times."""
    known = lambda df, name: stash(df.where(F.col("year") <= YEAR), name)
    pairs = known(V.pair_flows(spark, d), "pair-flows")
    inflows, outflows = known(V.inflows(spark, d, pairs), "inflows"), known(V.outflows(spark, d, pairs), "outflows")
    conflicts = known(V.conflicts(spark, d), "conflicts")
    return R.Evidence(V.regions(spark, d).select("region"), known(V.stats(spark, d), "stats"), conflicts, inflows, outflows, V.adjacency(spark, d))


def evidence_now(spark, d) -> R.Evidence:
    """Evidence of YEAR alone, as plans: for queries that read each table once."""
    tables = V.stats(spark, d), V.conflicts(spark, d), V.inflows(spark, d), V.outflows(spark, d)
    return R.Evidence(V.regions(spark, d).select("region"), *tables, V.adjacency(spark, d)).of(YEAR)


_W = "greatest(0.0::double, least(100.0::double, {c} * 0.25::double + {i} * 0.25::double + {o} * 0.2::double + activity * 0.2::double + opium * 0.1::double))"


def _notes(rel: str, key: str, value: str, name: str) -> str:
    return f"""select region, '{name}' as "set", k "key", families, cast(floor(dev * 100 + 0.5) as bigint) deviation_pct from (select *, greatest(hi - mean, mean - lo) / mean dev from
  (select region, {key} k, count(distinct family) families, sum({value} * reliability) / sum(reliability) mean, max({value}) hi, min({value}) lo from {rel} where source_name is not null group by all) where families >= 2 and mean > 0) where dev > 0.5"""


def _hhi(side: str, rel: str, key: str) -> str:
    return f"""{side}_h as (select region, cast(floor(sum(v * v)::double * 10000.0 / (max(t) * max(t))::double + 0.5) as bigint) {side}_hhi, max(case when rn = 1 then k end) {side}_dominant, floor(max(v::double / t::double) * 100 * 10 + 0.5) / 10 {side}_share
  from (select *, sum(v) over (partition by region) t, row_number() over (partition by region order by v desc, k) rn from (select region, {key} k, sum(qty) v from {rel} group by all)) group by region)"""


RISK = f"""{V.EVIDENCE}, {MOMENTUM}, {TRAJECTORY}, i as (select * from inflows where year = {YEAR}), o as (select * from outflows where year = {YEAR}), c as (select * from conflicts where year = {YEAR}), s as (select * from stats where year = {YEAR}),
b0 as (select region, ha is not null has_stat, coalesce(cm, 0)::double conflict, coalesce(in_sum, 0) in_sum, coalesce(out_sum, 0) out_sum, coalesce(ha, 0) ha, coalesce("index", 0)::double activity,
  cast(coalesce(nc, 0) + coalesce(ni, 0) + coalesce(no_, 0) + case when ha is not null then 1 else 0 end as bigint) evidence,
  (select max(x) from (select sum(weighted) x from i group by region)) max_in, (select max(x) from (select sum(qty) x from o group by region)) max_out, (select max(ha) from s) max_ha
  from regions left join (select region, max(intensity) cm, count(*) nc from c group by region) using (region) left join (select region, sum(weighted) in_sum, count(*) ni from i group by region) using (region)
  left join (select region, cast(sum(qty) as bigint) out_sum, count(*) no_ from o group by region) using (region) left join s using (region)),
b1 as (select *, in_sum::double / max_in::double * 100 inflow, out_sum::double / max_out::double * 100 outflow, ha::double / max_ha * 100 opium from b0),
base as (select *, {_W.format(c="conflict", i="inflow", o="outflow")} raw_score, cast(floor({_W.format(c="conflict", i="inflow", o="outflow")} + 0.5) as bigint) risk_score from b1),
names as (select distinct region, source_name, family, reliability from (select region, source_name, family, reliability from c union all select region, source_name, family, reliability from i union all select region, source_name, family, reliability from o) where source_name is not null),
div as (select region, count(distinct family) source_diversity, count(distinct source_name) raw_names, avg(reliability) reliability from names group by region),
diversity as (select *, case when source_diversity >= 2 then 'multi-source' when source_diversity = 1 then 'single-source' else 'unverified' end verification from div),
notes as ({_notes("i", "product", "qty", "inflow")} union all {_notes("c", "kind", "intensity", "event")} union all {_notes("o", "product", "qty", "outflow")}),
note_list as (select region, string_agg("set" || ' ' || "key" || ': ' || families || ' source families, ' || deviation_pct || '% from their mean', '; ' order by case "set" when 'inflow' then 1 when 'event' then 2 else 3 end, "key") notes from notes group by region),
fresh0 as (select region, max(year) latest from (select region, year from stats union all select region, year from conflicts union all select region, year from inflows union all select region, year from outflows) where year <= {YEAR} group by region),
fresh as (select region, latest, {YEAR} - latest age, case when {YEAR} - latest >= 3 then 'stale' when {YEAR} - latest >= 1 then 'aging' else 'current' end staleness from fresh0),
{_hhi("inflow", "i", "origin")}, {_hhi("outflow", "o", "corridor")},
parts as (select coalesce(a.region, b.region) region, coalesce(a.family, b.family) family, coalesce(x, 0) x, coalesce(y, 0) y from (select region, family, sum(weighted) x from i group by all) a full join (select region, family, sum(qty) y from o where source_name is not null group by all) b on a.region = b.region and a.family = b.family),
lofo as (select region, family, risk_score, {_W.format(c="conflict", i="((in_sum - x)::double / max_in::double * 100)", o="((out_sum - y)::double / max_out::double * 100)")} w from base join parts using (region) where risk_score >= {P.high}),
frag0 as (select *, row_number() over (partition by region order by w, family) rn from lofo where w < risk_score),
frag as (select region, true fragile, family, cast(risk_score - floor(w + 0.5) as bigint) as "drop" from frag0 where rn = 1 and floor(w + 0.5) < {P.high}),
near0 as (select a.region, neighbor, b.risk_score s, row_number() over (partition by a.region order by b.risk_score desc, neighbor) rn from adjacency a join base b on b.region = neighbor where b.risk_score > 0),
near as (select b.region, neighbor, coalesce(s, 0) neighbor_score, coalesce(s, 0) >= {P.high} and risk_score < {P.high} and coalesce(s, 0) - risk_score >= {P.gap} spillover_watch from base b left join near0 n on n.region = b.region and rn = 1),
act as (select distinct region, actor from c),
act0 as (select a.region, b.region r, a.actor, s.risk_score s, row_number() over (partition by a.region order by s.risk_score desc, b.region, a.actor) rn from act a join act b on a.actor = b.actor and a.region <> b.region join base s on s.region = b.region where s.risk_score > 0),
net as (select b.region, actor, r actor_region, coalesce(s, 0) actor_score, coalesce(s, 0) >= {P.high} and risk_score < {P.high} and coalesce(s, 0) - risk_score >= {P.gap} actor_watch from base b left join act0 n on n.region = b.region and rn = 1),
ranked_drivers as (select region, array_to_string(list_transform(list_sort([struct_pack(v := -conflict, i := 0, l := 'conflict pressure'), struct_pack(v := -inflow, i := 1, l := 'inbound precursor pressure'), struct_pack(v := -outflow, i := 2, l := 'seized outbound flow'), struct_pack(v := -activity, i := 3, l := 'synthetic-drug activity'), struct_pack(v := -opium, i := 4, l := 'opium cultivation')])[1:3], lambda x: x.l), ', ') drivers from base),
tiers as (select base.region, inflow_hhi, inflow_dominant, inflow_share, outflow_hhi, outflow_dominant, outflow_share,
  case when inflow_hhi is null then 'insufficient-data' when inflow_hhi > 2500 then 'concentrated' when inflow_hhi >= 1500 then 'moderate' else 'diversified' end inflow_tier,
  case when outflow_hhi is null then 'insufficient-data' when outflow_hhi > 2500 then 'concentrated' when outflow_hhi >= 1500 then 'moderate' else 'diversified' end outflow_tier
  from base left join inflow_h using (region) left join outflow_h using (region)),
conf as (select region, cast(floor(greatest(0.0::double, least(100.0::double, least(100, evidence * 16) * 0.45::double + least(100, coalesce(source_diversity, 0) * 34) * 0.35::double * (0.5::double + 0.5::double * coalesce(reliability, 0)) + case when has_stat then 20.0::double else 0.0::double end
  - case when notes is not null then 15.0::double else 0.0::double end - case staleness when 'stale' then 12.0::double when 'aging' then 4.0::double else 0.0::double end)) + 0.5) as bigint) confidence_score
  from base left join diversity using (region) left join note_list using (region) left join fresh using (region)),
briefing as (select region, {YEAR} as "year", risk_score, confidence_score, coalesce(source_diversity, 0) source_diversity, coalesce(raw_names, 0) raw_names, evidence, cast(floor(conflict + 0.5) as bigint) conflict, cast(floor(inflow + 0.5) as bigint) inflow, cast(floor(outflow + 0.5) as bigint) outflow, cast(floor(activity + 0.5) as bigint) activity, ha,
  drivers, coalesce(verification, 'unverified') verification, notes is not null has_conflict, coalesce(notes, '') notes, floor(coalesce(reliability, 0) * 100 + 0.5) / 100 reliability, coalesce(trajectory, 'insufficient-data') trajectory, change_pct, baseline_year, latest, age, coalesce(staleness, 'no-data') staleness,
  inflow_hhi, inflow_tier, inflow_dominant, inflow_share, outflow_hhi, outflow_tier, outflow_dominant, outflow_share, coalesce(fragile, false) fragile, family fragile_family, "drop" fragile_drop,
  neighbor, neighbor_score, spillover_watch, actor, actor_region, actor_score, actor_watch, spillover_watch and actor_watch compound_warning
  from base left join diversity using (region) left join note_list using (region) left join fresh using (region) left join trajectories using (region) left join tiers using (region) left join frag using (region) join near using (region) join net using (region) join conf using (region) join ranked_drivers using (region))"""


@query("r1_pressures", f"with {RISK} select region, floor(conflict * 100 + 0.5) / 100 conflict, floor(inflow * 100 + 0.5) / 100 inflow, floor(outflow * 100 + 0.5) / 100 outflow, activity, floor(opium * 100 + 0.5) / 100 opium from base")
def r1(spark, d):
    return R.pressures(evidence_now(spark, d)).select("region", *(half_up(F.col(k), 2).alias(k) for k in ("conflict", "inflow", "outflow", "activity", "opium")))


@query("r2_risk_score", f"with {RISK} select region, risk_score from base")
def r2(spark, d):
    return R.pressures(evidence_now(spark, d)).select("region", "risk_score")


@query("r3_source_diversity", f"with {RISK} select region, source_diversity, raw_names, floor(reliability * 10000 + 0.5) / 10000 reliability from diversity")
def r3(spark, d):
    return R.source_diversity(evidence_now(spark, d)).select("region", "source_diversity", "raw_names", half_up(F.col("reliability"), 4).alias("reliability"))


@query("r4_verification_tier", f"with {RISK} select verification, count(*) n from diversity group by verification")
def r4(spark, d):
    return R.source_diversity(evidence_now(spark, d)).groupBy("verification").agg(F.count(F.lit(1)).alias("n"))


@query("r5_confidence", f"with {RISK} select region, confidence_score from conf")
def r5(spark, d):
    e = evidence(spark, d)
    return R.with_confidence(R.pressures(e.of(YEAR)), e, YEAR, P).select("region", "confidence_score")


@query("r6_weighted_disagreement", f"with {V.EVIDENCE}, g as (select region, product, year, count(distinct family) families, sum(qty * reliability) / sum(reliability) mean, max(qty) hi, min(qty) lo from inflows group by all) select region, product, year, families, floor(mean * 100 + 0.5) / 100 mean, cast(floor(greatest(hi - mean, mean - lo) / mean * 100 + 0.5) as bigint) deviation_pct from g where families >= 2 and mean > 0 and greatest(hi - mean, mean - lo) / mean > 0.5")
def r6(spark, d):
    return R.disagreement(V.inflows(spark, d), ["region", "product", "year"], "qty")


@query("r7_conflict_notes", f"with {RISK} select region, \"set\", \"key\", families, deviation_pct from notes")
def r7(spark, d):
    return R.conflict_notes(evidence_now(spark, d))


@query("r8_corridor_hhi", f"with {RISK} select region, inflow_hhi, inflow_dominant, inflow_share, outflow_hhi, outflow_dominant, outflow_share from tiers")
def r8(spark, d):
    e = evidence_now(spark, d)
    return R.corridors(e.regions, e).select("region", *(f"{s}_{k}" for s in ("inflow", "outflow") for k in ("hhi", "dominant", "share")))


@query("r9_single_source_fragility", f"with {RISK} select * from frag")
def r9(spark, d):
    e = evidence(spark, d).of(YEAR)
    return R.fragility(R.pressures(e), e, P)


def _scores(spark, d):
    """A row per region, written once: watches read it several times."""
    return stash(R.pressures(evidence_now(spark, d)).select("region", "risk_score"), "scores")


@query("r10_spillover_watch", f"with {RISK} select * from near")
def r10(spark, d):
    return R.spillover(_scores(spark, d), V.adjacency(spark, d), P)


@query("r11_actor_network_watch", f"with {RISK} select * from net")
def r11(spark, d):
    return R.actor_network(_scores(spark, d), V.conflicts(spark, d).where(F.col("year") == YEAR), P)


@query("r12_compound_warning", f"with {RISK} select region, spillover_watch and actor_watch compound_warning from near join net using (region)")
def r12(spark, d):
    e = evidence_now(spark, d)
    return R.watches(_scores(spark, d), e, P).select("region", "compound_warning")


@query("r13_readiness", f"""with {RISK} select cast(floor(count(*) filter (evidence > 1 and source_diversity > 0)::double / count(*) * 100 + 0.5) as bigint) provenance_pct, count(*) filter (source_diversity >= 2) multi_source, count(*) filter (risk_score >= {P.high}) high_risk, cast(sum(evidence) as bigint) evidence, count(*) filter (has_conflict) conflicted,
  count(*) filter (trajectory = 'rising') rising, count(*) filter (spillover_watch) spillover, count(*) filter (staleness = 'stale') stale, count(*) filter (inflow_tier = 'concentrated') concentrated_in, count(*) filter (outflow_tier = 'concentrated') concentrated_out, count(*) filter (raw_names > source_diversity) duplicate_names,
  count(*) filter (actor_watch) actor_network, count(*) filter (fragile) single_source_fragile, count(*) filter (compound_warning) compound from briefing""")
def r13(spark, d):
    return R.readiness(R.risk_briefing(evidence(spark, d), YEAR, P), P)


@query("r14_risk_briefing", f"with {RISK} select * from briefing")
def r14(spark, d):
    return R.risk_briefing(evidence(spark, d), YEAR, P)


@query("k4_top_drivers", f"with {RISK} select * from ranked_drivers")
def k4(spark, d):
    return R.pressures(evidence_now(spark, d)).select("region", F.array_join(R.drivers(), ", ").alias("drivers"))


@query("j8_spine_join", f"with {V.EVIDENCE}, x as (select region, count(*) n from conflicts where intensity > 97 group by region) select region, coalesce(n, 0) n from regions left join x using (region)")
def j8(spark, d):
    x = V.conflicts(spark, d).where("intensity > 97").groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    return V.regions(spark, d).select("region").join(x, "region", "left").fillna(0, ["n"])


@query("j10_adjacency_top", f"with {RISK} select region, neighbor, neighbor_score from near")
def j10(spark, d):
    return R.spillover(_scores(spark, d), V.adjacency(spark, d), P).select("region", "neighbor", "neighbor_score")


@query("j11_shared_actor", f"with {V.EVIDENCE}, a as (select distinct region, actor from conflicts where intensity > 60) select x.region a, y.region b, count(*) shared from a x join a y on x.actor = y.actor and x.region < y.region group by all")
def j11(spark, d):
    # Regions an actor appears in are few and distinct here; scores use actor_network, which lists no pairs.
    a = V.conflicts(spark, d).where("intensity > 60").select("region", "actor").distinct()
    return a.alias("x").join(a.alias("y"), (F.col("x.actor") == F.col("y.actor")) & (F.col("x.region") < F.col("y.region"))).groupBy(F.col("x.region").alias("a"), F.col("y.region").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


@query("j6_inner_movers", f"with {V.OUTCOMES}, a as (select jurisdiction, sum(deaths) x from outcomes where year = 1996 and product = '5-LOW' group by all), b as (select jurisdiction, sum(deaths) y from outcomes where year = 2001 and product = '5-LOW' group by all) select jurisdiction, cast(x as bigint) x, cast(y as bigint) y from a join b using (jurisdiction)")
def j6(spark, d):
    o = V.outcomes(spark, d).where("product = '5-LOW'")
    at = lambda y, n: o.where(F.col("year") == y).groupBy("jurisdiction").agg(F.sum("deaths").alias(n))
    return at(1996, "x").join(at(2001, "y"), "jurisdiction")


@query("a16b_network_chokepoints", f"with {V.EVIDENCE}, g as (select corridor, cast(sum(qty) as bigint) quantity, count(distinct region) feeders from outflows where year = {YEAR} group by corridor), h as (select *, floor(quantity::double / (sum(quantity) over ())::double * 100 * 10 + 0.5) / 10 share_pct from g) select *, feeders >= 2 or share_pct >= 40 systemic from h")
def a16b(spark, d):
    return A.chokepoints(V.outflows(spark, d).where(F.col("year") == YEAR), "corridor", "region", "qty")

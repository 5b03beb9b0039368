"""Queries of triangulation (T), with its vocabulary bridge (J13) and the scan of all pairs (J12)."""

from pyspark.sql import functions as F

from corrob.functions.columns import half_up
from corrob.operators import series as S
from corrob.operators import triangulate as T
from corrob.plans import views as V
from corrob.plans.registry import query
from corrob.sources.shared import stash

NOW, BEFORE = 2000, 1996
#: product, its mortality substance and wastewater drug (null: none), caveat.
BRIDGE = (("ECONOMY", "1-URGENT", "FURNITURE", None), ("LARGE", "2-HIGH", "MACHINERY", "bundles two substances"), ("MEDIUM", "3-MEDIUM", None, None), ("PROMO", "5-LOW", "BUILDING", None), ("SMALL", None, "HOUSEHOLD", "no death code"), ("STANDARD", "4-NOT SPECIFIED", "AUTOMOBILE", None))


def bridge(spark):
    return spark.createDataFrame(list(BRIDGE), "product string, substance string, drug string, caveat string")


def pairs(spark, d):
    """All countries with all products: two short dimensions, the products as an array."""
    n = V.table(spark, d, "nation").select(F.col("n_name").alias("country"))
    return n.select("country", F.explode(F.array(*(F.lit(b[0]) for b in BRIDGE))).alias("product"))


def seizure_lines(spark, d):
    """country, product, year, qty of lines of small sizes (below 4). Parts are cut to those first, so that few lines meet orders."""
    return V.flows(spark, d, "dest product year qty", parts="size < 4").withColumnRenamed("dest", "country")


def price_lines(spark, d):
    """country, product, year, qty, cents: prices rest on where lines come from, so lines don't meet orders."""
    return V.flows(spark, d, "origin product year qty cents").withColumnRenamed("origin", "country")


def compared(year):
    return F.coalesce(year.isin(NOW, BEFORE), F.lit(False))


def line_cells(lines, **sums):
    """Sums a country, product and year, of the two years that readings compare."""
    return lines.where(compared(F.col("year"))).groupBy("country", "product", "year").agg(*(F.sum(c).alias(name) for name, c in sums.items()))


def with_other_years(at, cells, lines):
    """``cells``, and a row without a year for pairs that have only lines of other years. Lines of other years are looked at where a pair has no cell, so at scale mostly nowhere."""
    lacking = at.join(cells, ["country", "product"], "left_anti").collect()  # a row a pair at most
    if not lacking:
        return cells
    rest = lines.where(~compared(F.col("year")) & F.col("country").isin(*{r["country"] for r in lacking}) & F.col("product").isin(*{r["product"] for r in lacking}))
    return cells.unionByName(rest.select("country", "product").distinct(), allowMissingColumns=True)


def order_cells(spark, d, every_year):
    """country, site, substance, year, month, n, cents: orders are read once for mortality and loads."""
    o = V.orders_by_nation(spark, d)
    o = o if every_year else o.where(compared(F.year("o_orderdate")))
    keys = [F.col("n_name").alias("country"), F.col("c_mktsegment").alias("site"), F.col("o_orderpriority").alias("substance"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")]
    return o.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def all_readings(spark, d, reasons=False):
    """The readings of all modalities. They rest on the two years compared; only ``reasons`` also ask whether other years have anything."""
    at, b = pairs(spark, d), F.broadcast(bridge(spark))  # six rows
    orders, sold = stash(order_cells(spark, d, reasons), "order-cells"), price_lines(spark, d)
    f, p = stash(line_cells(seizure_lines(spark, d), v="qty"), "seizure-cells"), stash(line_cells(sold, qty="qty", cents="cents"), "price-cells")
    if reasons:
        f, p = with_other_years(at, f, seizure_lines(spark, d)), with_other_years(at, p, sold)
    p = p.select("country", "product", "year", half_up(F.col("cents") / F.col("qty") / 100, 2).alias("v"))
    covered = V.table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("country"))
    # Windows of 2001 are partial.
    o = orders.where("year <> 2001").groupBy("country", "year", "substance").agg(F.sum("n").alias("v")).join(covered, "country")
    m = o.join(b, "substance").select("country", "product", "year", "v")
    rate = orders.where("month < 7").groupBy("site", "country", "year", "month").agg((F.sum("cents") / F.sum("n") / 100).alias("rate"))
    w = rate.groupBy("site", "country", "year").agg(F.round(F.avg("rate"), 6).alias("v")).withColumnRenamed("site", "drug")
    w = w.join(b, "drug").where(F.length("country") == 9).select("country", "product", "year", "v")
    r = T.readings(at, "seizures", f, NOW, BEFORE, zero_is_absent=True).unionByName(T.readings(at, "retail_price", p, NOW, BEFORE))
    r = r.unionByName(T.readings(at, "mortality", m, NOW, BEFORE, covered)).unionByName(T.readings(at, "wastewater", w, NOW, BEFORE, w))
    return r if reasons else r.drop("reason")


_BRIDGE = "bridge(product, substance, drug, caveat) as (values " + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in b) + ")" for b in BRIDGE) + ")"


def _reading(name: str, rel: str, absent: bool = False, covered: str | None = None) -> str:
    cur, base = ("coalesce(cur, 0.0::double)", "coalesce(base, 0.0::double)") if absent else ("cur", "base")
    ok = f"({cur} > 0 or {base} > 0)" if absent else "(cur is not null and base is not null)"
    reason = "case when g.country is null then 'product not reported' else 'year not reported' end"
    if covered:
        reason = f"case when p.country not in (select country from {covered}) then 'country not covered (covered: ' || (select string_agg(country, ', ' order by country) from (select distinct country from {covered})) || ')' else {reason} end"
    return f"""select p.country, p.product, '{name}' modality, {ok} available, case when {ok} then {cur} end as "current", case when {ok} then {base} end baseline, case when {ok} and {base} > 0 then ({cur} - {base}) / {base} end "change", case when not {ok} then {reason} end reason
  from pairs p left join (select country, product, max(v) filter (year = {NOW})::double cur, max(v) filter (year = {BEFORE})::double base from {rel} group by all) g on g.country = p.country and g.product = p.product"""


_DIR = "(case when {x} > 0.15 then 1 when {x} < -0.15 then -1 else 0 end)"
_D = {m: _DIR.format(x=f"ch_{m}") for m, _, _ in T.MODALITIES}


def _verdict(drop: str | None) -> str:
    on = {m: "false" if m == drop else f"on_{m}" for m, _, _ in T.MODALITIES}
    s = f"(case when {on['seizures']} then {_D['seizures']} when {on['retail_price']} then -{_D['retail_price']} else 0 end)"
    d = f"(case when {on['wastewater']} then {_D['wastewater']} when {on['mortality']} then {_D['mortality']} else 0 end)"
    n = " + ".join(f"({x})::int" for x in on.values())
    return f"(case when not ({on['seizures']} or {on['retail_price']}) or not ({on['mortality']} or {on['wastewater']}) or {n} < 2 then 'untriangulated' when {s} = 1 and {d} = 1 then 'concordantExpansion' when {s} = -1 and {d} = -1 then 'concordantContraction' when {s} = 1 and {d} <= 0 then 'enforcementArtifact' when {s} <= 0 and {d} = 1 then 'undetectedExpansion' when {s} = 0 and {d} = 0 then 'concordantContraction' else 'mixedSignals' end)"


_S = f"(case when on_seizures then {_D['seizures']} when on_retail_price then -{_D['retail_price']} else 0 end)"
_DD = f"(case when on_wastewater then {_D['wastewater']} when on_mortality then {_D['mortality']} else 0 end)"
TRI = f"""{V.PRICES}, {V.OUTCOMES}, {V.LOAD}, {_BRIDGE}, pairs as (select n_name country, b.product from nation cross join bridge b), covered as (select n_name country from nation where n_nationkey % 3 = 0),
vf as (select dest country, product, year, sum(qty) v from flows where size < 4 group by all), vp as (select country, product, year, price v from prices),
vm as (select jurisdiction country, b.product, year, deaths v from outcomes o join bridge b on b.substance = o.product where not "partial" and jurisdiction in (select country from covered)),
vw as (select country, b.product, year, round(avg(rate), 6) v from load join bridge b on b.drug = site where month < 7 and len(country) = 9 group by all),
readings as ({_reading("seizures", "vf", True)} union all {_reading("retail_price", "vp")} union all {_reading("mortality", "vm", False, "covered")} union all {_reading("wastewater", "vw", False, "vw")}),
wide as (select country, product, {", ".join(f"coalesce(bool_or(available) filter (modality = '{m}'), false) on_{m}, max(change) filter (modality = '{m}') ch_{m}" for m, _, _ in T.MODALITIES)} from readings group by all),
v0 as (select *, {_verdict(None)} verdict from wide),
v1 as (select *, {_S} supply, {_DD} demand, {" + ".join(f"on_{m}::int" for m, _, _ in T.MODALITIES)} collectors,
  case when verdict = 'untriangulated' then null {" ".join(f"when on_{m} and {_verdict(m)} <> verdict and {_verdict(m)} <> 'untriangulated' then '{m}'" for m, _, _ in T.MODALITIES)} end fragile_modality,
  on_seizures and on_retail_price and {_D["seizures"]} <> 0 and {_D["retail_price"]} <> 0 and {_D["seizures"]} <> -{_D["retail_price"]} supply_conflict from v0),
tri as (select *, fragile_modality is not null fragile, verdict <> 'untriangulated' and collectors = 2 minimum_coverage from v1)"""


@query("t1_readings", f"with {TRI} select country, product, modality, available, floor(\"current\" * 100 + 0.5) / 100 as \"current\", floor(baseline * 100 + 0.5) / 100 baseline, floor(\"change\" * 10000 + 0.5) / 10000 as \"change\" from readings")
def t1(spark, d):
    r = all_readings(spark, d)
    return r.select("country", "product", "modality", "available", half_up(F.col("current"), 2).alias("current"), half_up(F.col("baseline"), 2).alias("baseline"), half_up(F.col("change"), 4).alias("change"))


@query("t2_absent_reason", f"with {TRI} select modality, reason, count(*) n from readings where not available group by all")
def t2(spark, d):
    return all_readings(spark, d, reasons=True).where("not available").groupBy("modality", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("t3_direction", f"with {TRI} select modality, {_DIR.format(x='change')} direction, count(*) n from readings where available group by all")
def t3(spark, d):
    return all_readings(spark, d).where("available").groupBy("modality", T.direction(F.col("change")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


def tri(spark, d):
    return T.triangulate(T.wide(all_readings(spark, d)))


@query("t4_verdict", f"with {TRI} select country, product, verdict from tri")
def t4(spark, d):
    return tri(spark, d).select("country", "product", "verdict")


@query("t5_fragile_verdict", f"with {TRI} select country, product, fragile, fragile_modality from tri")
def t5(spark, d):
    return tri(spark, d).select("country", "product", "fragile", "fragile_modality")


@query("t6_coverage_conflict", f"with {TRI} select country, product, supply, demand, cast(collectors as int) collectors, supply_conflict, minimum_coverage from tri")
def t6(spark, d):
    return tri(spark, d).select("country", "product", "supply", "demand", "collectors", "supply_conflict", "minimum_coverage")


@query("t7_caveats", f"with {TRI} select country, t.product, array_to_string(list_filter([caveat, case when supply_conflict then 'supply signals disagree' end, case when fragile then 'not robust without ' || fragile_modality end, case when minimum_coverage then 'two collectors only' end], lambda x: x is not null), '; ') caveats from tri t join bridge using (product)")
def t7(spark, d):
    t = tri(spark, d).join(F.broadcast(bridge(spark)), "product")  # six rows
    return t.select("country", "product", F.array_join(T.caveats(F.col("caveat")), "; ").alias("caveats"))


@query("t8_indexed_series", f"with {TRI}, u as (select 'seizures' modality, country, product, year, v::double v from vf union all select 'retail_price', country, product, year, v from vp union all select 'mortality', country, product, year, v from vm), f as (select *, first_value(v) over (partition by modality, country, product order by year) b from u) select modality, country, product, year, case when b > 0 then floor(v / b * 100 * 10 + 0.5) / 10 end as \"index\" from f")
def t8(spark, d):
    b = F.broadcast(bridge(spark))
    f = seizure_lines(spark, d).groupBy("country", "product", "year").agg(F.sum("qty").cast("double").alias("v")).withColumn("modality", F.lit("seizures"))
    p = V.prices(spark, d).select("country", "product", "year", F.col("price").alias("v"), F.lit("retail_price").alias("modality"))
    covered = V.table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("country"))
    o = V.outcomes(spark, d).where("not partial").withColumnRenamed("product", "substance").join(b, "substance").join(covered, F.col("jurisdiction") == F.col("country"))
    u = f.unionByName(p).unionByName(o.select("country", "product", "year", F.col("deaths").cast("double").alias("v"), F.lit("mortality").alias("modality")))
    return S.rebased(u, ["modality", "country", "product"], "year", "v").drop("v")


@query("t9_scan_divergences", f"with {TRI} select country, product, verdict, floor(abs(coalesce(case when on_seizures then ch_seizures else -ch_retail_price end, 0) - coalesce(case when on_wastewater then ch_wastewater else ch_mortality end, 0)) * 1000 + 0.5) / 1000 gap, verdict in ('enforcementArtifact', 'undetectedExpansion', 'mixedSignals') divergent from tri where verdict <> 'untriangulated'")
def t9(spark, d):
    return T.scan_divergences(tri(spark, d)).select("country", "product", "verdict", "gap", "divergent")


@query("t10_precomputed_divergence", f"with {TRI}, p(label, a, b) as (values ('supply vs demand', 'seizures', 'wastewater'), ('price vs deaths', 'retail_price', 'mortality')) select label, x.country, x.product, floor(x.change * 1000 + 0.5) / 1000 a_change, floor(y.change * 1000 + 0.5) / 1000 b_change from p join readings x on x.modality = a and x.available join readings y on y.modality = b and y.available and y.country = x.country and y.product = x.product")
def t10(spark, d):
    w = T.wide(all_readings(spark, d))
    out = None
    for label, a, b in (("supply vs demand", "seizures", "wastewater"), ("price vs deaths", "retail_price", "mortality")):
        x = w.where(F.col(f"on_{a}") & F.col(f"on_{b}")).select(F.lit(label).alias("label"), "country", "product", half_up(F.col(f"ch_{a}"), 3).alias("a_change"), half_up(F.col(f"ch_{b}"), 3).alias("b_change"))
        out = x if out is None else out.unionByName(x)
    return out


@query("j12_pair_scan", f"with {TRI} select p.country, p.product, count(v.v) as \"years\" from pairs p left join vf v on v.country = p.country and v.product = p.product group by all")
def j12(spark, d):
    f = seizure_lines(spark, d).groupBy("country", "product").agg(F.countDistinct("year").alias("years"))
    return pairs(spark, d).join(f, ["country", "product"], "left").fillna(0, ["years"])


@query("j13_vocabulary_bridge", f"with {V.OUTCOMES}, {_BRIDGE} select b.product, substance, cast(sum(deaths) as bigint) deaths from bridge b left join outcomes o on o.product = substance group by all")
def j13(spark, d):
    o = V.outcomes(spark, d).groupBy(F.col("product").alias("substance")).agg(F.sum("deaths").alias("deaths"))
    return bridge(spark).join(o, "substance", "left").select("product", "substance", "deaths")

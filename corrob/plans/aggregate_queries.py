"""Queries of the aggregation family (A)."""

from pyspark.sql import functions as F

from corrob.functions.columns import excel_serial_year, half_up
from corrob.functions.sources import reliability_tier, tier_sql
from corrob.operators import aggregate as A
from corrob.plans import views as V
from corrob.plans.registry import query


def audited(spark, d):
    """Flows with the provenance fields of audited records, by rule from keys."""
    f = V.flows(spark, d, "dest year product qty cust supp orderkey partkey size")
    k = F.col("orderkey") % 10
    return f.withColumns({
        "quantity_relation": F.when(k < 6, "exact").when(k < 8, "approximate").otherwise("above"),
        "record_kind": F.when(F.col("partkey") % 9 == 0, F.lit(None).cast("string")).when(F.col("partkey") % 9 == 1, "derived").otherwise("seizure"),
        "eligibility": F.when(F.col("supp") % 3 == 0, "excluded").otherwise("eligible"),
        "aggregation_group": F.when(F.col("size") > 45, F.lit(None).cast("string")).when(F.col("cust") % 50 == 0, "annex").otherwise("report"),
    })


AUDITED = V.FLOWS + """, audited as (select *, case when orderkey % 10 < 6 then 'exact' when orderkey % 10 < 8 then 'approximate' else 'above' end quantity_relation,
  case when partkey % 9 = 0 then null when partkey % 9 = 1 then 'derived' else 'seizure' end record_kind, case when supp % 3 = 0 then 'excluded' else 'eligible' end eligibility,
  case when size > 45 then null when cust % 50 = 0 then 'annex' else 'report' end aggregation_group from flows),
checked as (select *, coalesce(quantity_relation = 'exact' and record_kind is not null and record_kind <> 'derived' and eligibility = 'eligible' and aggregation_group is not null, false) ok from audited)"""


@query("a1_totals_by", f"with {V.FLOWS} select dest, cast(sum(qty) as bigint) total from flows where product = 'ECONOMY' and year = 1998 group by dest")
def a1(spark, d):
    return A.totals_by(V.flows(spark, d, "dest product year qty"), ["dest"], "qty", (F.col("product") == "ECONOMY") & (F.col("year") == 1998))


@query("a2_max_total", f"with {V.FLOWS} select cast(coalesce(max(s), 0) as bigint) most from (select sum(qty) s from flows where product = 'SMALL' group by dest, year)")
def a2(spark, d):
    return A.max_total(V.flows(spark, d, "dest year product qty").where("product = 'SMALL'"), ["dest", "year"], "qty")


@query("a3_group_totals", f"with {V.FLOWS} select dest, year, product, cast(sum(qty) as bigint) total from flows group by all")
def a3(spark, d):
    return A.totals_by(V.flows(spark, d, "dest year product qty"), ["dest", "year", "product"], "qty")


@query("a4_world_total", f"with {V.FLOWS} select year, cast(sum(qty) as bigint) total from flows group by year")
def a4(spark, d):
    return A.totals_by(V.flows(spark, d, "year qty"), ["year"], "qty")


@query("a5_groups_by_volume", f"with {V.FLOWS} select b.item, cast(coalesce(t, 0) as bigint) total from (select distinct p_brand item from part) b left join (select item, sum(qty) t from flows where year = 1998 and origin = 'NATION_3' and dest = 'NATION_7' group by item) f using (item)")
def a5(spark, d):
    few = V.flows(spark, d, "origin dest year item qty").where("year = 1998 and origin = 'NATION_3' and dest = 'NATION_7'")
    return A.groups_by_volume(few, V.table(spark, d, "part").withColumnRenamed("p_brand", "item"), "item", "qty")


_SIG = "case when m = 0 then 0.0 else floor(m * pow(10.0, 6 - ceil(log10(abs(m)))) + 0.5) / pow(10.0, 6 - ceil(log10(abs(m)))) end"


@query("a6_mean_with_coverage", f"with {V.LOAD}, a as (select site, country, year, avg(rate) m, count(distinct month) observed from load group by all) select site, country, year, {_SIG} mean, observed from a")
def a6(spark, d):
    return A.mean_with_coverage(V.monthly_load(spark, d), ["site", "country", "year"], "rate", "month")


@query("a7_avg_price", f"with {V.FLOWS} select product, origin, year, floor(avg(cents::double / qty) / 100 * 10000 + 0.5) / 10000 price, floor((100 - sum(disc)::double / count(*)) * 100 + 0.5) / 100 purity from flows group by all")
def a7(spark, d):
    return V.flows(spark, d, "product origin year cents qty disc").groupBy("product", "origin", "year").agg(half_up(F.avg(F.col("cents") / F.col("qty")) / 100, 4).alias("price"), half_up(100 - F.avg("disc"), 2).alias("purity"))


@query("a8_event_intensity", """select user_id % 10 as grp, event_type, count(*) events, cast(sum(floor(greatest("value", 0))) as bigint) weight,
  cast(least(100, greatest(5, floor(14 * ln(1 + count(*)) + 9 * ln(1 + sum(floor(greatest("value", 0)))) + 0.5))) as bigint) intensity from events group by all""")
def a8(spark, d):
    e = V.table(spark, d, "events").withColumn("grp", F.col("user_id") % 10)
    return A.event_intensity(e, ["grp", "event_type"], F.floor(F.greatest("value", F.lit(0.0))).cast("long"))


@query("a9_weekly_rollup", """with e as (select date_diff('day', date '1899-12-30', cast(ts as date)) serial, event_type, cast(floor(greatest("value", 0)) as bigint) f from events),
  g as (select cast(year(date '1899-12-30' + cast(serial // 7 * 7 as int)) as int) "year", cast(serial // 7 * 7 as bigint) "week", event_type, cast(sum(1 + f) as bigint) burden from e group by all)
  select "year", "week", event_type, burden, cast(floor(100 * ln(1 + burden) / ln(1 + max(burden) over ()) + 0.5) as bigint) intensity from g""")
def a9(spark, d):
    serial = F.datediff(F.to_date("ts"), F.lit("1899-12-30").cast("date"))
    e = V.table(spark, d, "events").withColumn("week", (F.floor(serial / 7) * 7).cast("long")).withColumn("year", excel_serial_year(F.col("week")))
    return A.relative_burden(e, ["year", "week", "event_type"], 1 + F.floor(F.greatest("value", F.lit(0.0))).cast("long"))


@query("a10_multi_histogram", f"""with {V.FLOWS}, f as (select * from flows where disc >= 5)
  select 'origin' dimension, origin as key, count(*) records from f group by origin union all select 'dest', dest, count(*) from f group by dest
  union all select 'product', product, count(*) from f group by product union all select 'item', item, count(*) from f group by item
  union all select 'year', cast(year as varchar), count(*) from f group by year""")
def a10(spark, d):
    return A.histograms(V.flows(spark, d, "origin dest product item year disc").where("disc >= 5"), ["origin", "dest", "product", "item", "year"])


@query("a11_flow_summary", f"with {AUDITED} select dest, year, count(*) filter (ok) eligible, count(*) filter (not ok) excluded, count(distinct case when ok then aggregation_group end) as \"groups\", case when count(distinct case when ok then aggregation_group end) = 1 then cast(sum(case when ok then qty end) as bigint) end subtotal from checked group by dest, year")
def a11(spark, d):
    return A.flow_summary(audited(spark, d), ["dest", "year"], "qty")


@query("a12_aggregation_status", f"""with {AUDITED}, g as (select cust, count(*) records, count(*) filter (quantity_relation = 'exact') exact, count(*) filter (ok) eligible, count(distinct case when ok then aggregation_group end) grps, cast(sum(case when ok then qty end) as bigint) s from checked group by cust),
  h as (select *, case when records = 0 then 'no-records' when exact = 0 then 'non-exact-only' when eligible = 0 then 'exact-ineligible' when grps > 1 then 'mixed-groups' else 'computed' end status from g)
  select cust, records, exact, eligible, grps as "groups", status, case when status = 'computed' then s end quantity from h""")
def a12(spark, d):
    return A.aggregation_status(audited(spark, d), ["cust"], "qty")


@query("a13_element_counts", f"with {V.ENTITIES} select element, count(*) n from (select unnest(countries) element from entities) group by element order by n desc, element limit 10")
def a13(spark, d):
    return A.element_counts(V.entities(spark, d), "countries", 10)



def hhi_sql(with_: str, rel: str, by: str, key: str, final: str) -> str:
    return f"""with {with_}, each as (select {by}, {key} k, sum(qty) v from {rel} group by {by}, {key}),
  s as (select *, sum(v) over (partition by {by}) total, row_number() over (partition by {by} order by v desc, k) rn from each),
  hh as (select {by}, cast(floor(sum(v * v)::double * 10000.0 / (max(total) * max(total))::double + 0.5) as bigint) hhi, max(case when rn = 1 then k end) dominant, floor(max(v::double / total::double) * 100 * 10 + 0.5) / 10 dominant_share, count(*) n_keys from s group by {by}) {final}"""


_TIER = "case when hhi is null then 'insufficient-data' when hhi > 2500 then 'concentrated' when hhi >= 1500 then 'moderate' else 'diversified' end"


@query("a14_hhi", hhi_sql(V.FLOWS, "flows", "cust, year", "origin", f"select *, {_TIER} tier from hh"))
def a14(spark, d):
    return A.hhi(V.flows(spark, d, "cust year origin qty"), ["cust", "year"], "origin", "qty").withColumn("tier", A.concentration_tier(F.col("hhi")))


@query("a15_concentration_tier", hhi_sql(V.FLOWS, "flows", "cust", "origin", f"select {_TIER} tier, count(*) customers from hh group by all"))
def a15(spark, d):
    return A.hhi(V.flows(spark, d, "cust origin qty"), ["cust"], "origin", "qty").groupBy(A.concentration_tier(F.col("hhi")).alias("tier")).agg(F.count(F.lit(1)).alias("customers"))


@query("a16_chokepoints", f"with {V.FLOWS}, g as (select dest, cast(sum(qty) as bigint) quantity, count(distinct origin) feeders from flows group by dest), h as (select *, floor(quantity::double / (sum(quantity) over ())::double * 100 * 10 + 0.5) / 10 share_pct from g) select *, feeders >= 2 or share_pct >= 40 systemic from h")
def a16(spark, d):
    return A.chokepoints(V.flows(spark, d, "dest origin qty"), "dest", "origin", "qty")


@query("a17_rollup_profile", f"with {V.FLOWS} select year, product, cast(sum(qty) as bigint) total, count(*) records from flows where dest = 'NATION_4' group by grouping sets ((year), (product), (year, product), ())")
def a17(spark, d):
    f = V.flows(spark, d, "dest year product qty").where("dest = 'NATION_4'")
    return f.cube("year", "product").agg(F.sum("qty").alias("total"), F.count(F.lit(1)).alias("records"))


@query("a18_scope_partition", f"""with {V.ENTITIES}, e as (select program in ('1-URGENT', '2-HIGH') a, program = '5-LOW' b, len(countries) n from entities)
  select count(*) filter (a or b) scope, count(*) filter (a) specific, count(*) filter (not a and b) second_only, count(*) filter ((a or b) and n >= 2) multi_country, count(*) filter (a or b) = count(*) filter (a) + count(*) filter (not a and b) partitions from e""")
def a18(spark, d):
    return A.scope_partition(V.entities(spark, d).withColumn("programs", F.array("program")), "programs", ["1-URGENT", "2-HIGH"], ["5-LOW"])


@query("a19_rank_in_table", f"with {V.FLOWS}, g as (select dest, count(*) n from flows group by dest), r as (select *, row_number() over (order by n desc, dest) as rank from g) select dest, n, rank from r where dest in ('NATION_3', 'NATION_9')")
def a19(spark, d):
    # The rank counts what stands before, so no global sort is needed for two keys of a table.
    g = V.flows(spark, d, "dest").groupBy("dest").agg(F.count(F.lit(1)).alias("n"))
    mine = g.where(F.col("dest").isin("NATION_3", "NATION_9"))
    before = (F.col("o.n") > F.col("m.n")) | ((F.col("o.n") == F.col("m.n")) & (F.col("o.dest") <= F.col("m.dest")))
    # Two rows, broadcast: each total meets only those whose rank is asked for.
    return g.alias("o").join(F.broadcast(mine.alias("m")), before).groupBy("m.dest", "m.n").agg(F.count(F.lit(1)).alias("rank"))


@query("a20_overview_kpis", f"""with {V.FLOWS}, y as (select year, cast(sum(qty) as bigint) t from flows group by year), l as (select max(year) y from y)
  select (select t from y, l where year = y) latest_total, (select y from l) latest_year, floor(((select t from y, l where year = y)::double / (select t from y, l where year = y - 1)::double - 1) * 1000 + 0.5) / 1000 yoy,
  (select count(distinct dest) from flows) destinations, (select count(distinct product) from flows) products, (select count(*) from orders) orders""")
def a20(spark, d):
    f = V.flows(spark, d, "dest product year qty")
    years = A.totals_by(f, ["year"], "qty")
    last = years.agg(F.max("year").alias("latest_year"), F.max_by("total", "year").alias("latest_total"))
    before = years.agg(F.max(F.struct("year", "total")).alias("m"), F.array_sort(F.collect_list(F.struct("year", "total"))).alias("all"))  # a row per year
    yoy = before.select(half_up(F.col("m.total") / F.element_at("all", -2)["total"] - 1, 3).alias("yoy"))
    counts = f.agg(F.countDistinct("dest").alias("destinations"), F.countDistinct("product").alias("products"))
    orders = V.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"))
    one = F.lit(True)  # four rows of one row each
    return last.join(yoy, one).join(counts, one).join(orders, one)


@query("a21_peak", f"with {V.FLOWS}, y as (select dest, year, cast(sum(qty) as bigint) total from flows group by all), r as (select *, row_number() over (partition by dest order by total desc, year) a, row_number() over (partition by dest order by year desc) b from y) select dest, max(case when a = 1 then year end) peak_time, max(total) peak_value, max(case when b = 1 then total end) latest, floor((max(case when b = 1 then total end) - max(total))::double / max(total) * 1000 + 0.5) / 1000 from_peak from r group by dest")
def a21(spark, d):
    return A.peak(A.totals_by(V.flows(spark, d, "dest year qty"), ["dest", "year"], "qty"), ["dest"], "year", "total")


@query("a22_freshness", f"with {V.EVIDENCE} select source_name, max(year) latest, count(*) records from outflows group by source_name")
def a22(spark, d):
    return V.outflows(spark, d).groupBy("source_name").agg(F.max("year").alias("latest"), F.count(F.lit(1)).alias("records"))


@query("a23_latest_non_null", f"with {V.PRICES}, p as (select *, case when (year + len(country)) % 3 = 0 then null else price end v from prices) select product, country, max(year) as \"at\", arg_max(v, year) as \"value\" from p where v is not null group by all")
def a23(spark, d):
    p = V.prices(spark, d).withColumn("v", F.when((F.col("year") + F.length("country")) % 3 != 0, F.col("price")))
    return A.latest_non_null(p, ["product", "country"], "year", "v")


@query("a24_node_records", f"with {V.FLOWS}, t as (select orderkey, origin node, true o, false s from flows union all select orderkey, dest, false, true from flows) select node, count(distinct orderkey) records, bool_or(o) is_origin, bool_or(s) is_dest from t group by node")
def a24(spark, d):
    return A.node_records(V.flows(spark, d, "orderkey origin dest"), "orderkey", ["origin", "dest"])


@query("a25_category_share", f"with {V.FLOWS} select year, cast(count(*) as bigint) total, cast(count(*) filter (product = 'ECONOMY') as bigint) part, floor(count(*) filter (product = 'ECONOMY')::double / count(*) * 100 * 10 + 0.5) / 10 share_pct from flows group by year")
def a25(spark, d):
    return A.share_of(V.flows(spark, d, "year product").withColumn("one", F.lit(1)), ["year"], "one", F.col("product") == "ECONOMY")


@query("a26_field_coverage", """with o as (select o_orderkey, nullif(o_orderstatus, 'P') o_orderstatus, case when o_totalprice > 100000 then o_totalprice end o_totalprice, o_orderpriority from orders)
  select unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) field, unnest(['bigint', 'string', 'double', 'string']) "type",
  unnest([count(o_orderkey), count(o_orderstatus), count(o_totalprice), count(o_orderpriority)]) present,
  unnest([floor(x::double / n * 10000 + 0.5) / 10000 for x in [count(o_orderkey), count(o_orderstatus), count(o_totalprice), count(o_orderpriority)]]) as share from o, (select count(*) n from orders) group by n""")
def a26(spark, d):
    o = V.table(spark, d, "orders").withColumns({"o_orderstatus": F.nullif("o_orderstatus", F.lit("P")), "o_totalprice": F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))})
    return A.field_coverage(o, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@query("a27_relation_counts", f"with {V.ENTITIES} select 'entity-country' relation, 'entity' domain, 'country' as range, cast(sum(len(countries)) as bigint) n from entities union all select 'entity-program', 'entity', 'program', count(program) from entities union all select 'flow-dest', 'flow', 'country', count(*) from flows")
def a27(spark, d):
    e = V.entities(spark, d)
    rows = [
        e.agg(F.sum(F.size("countries").cast("long")).alias("n")).select(F.lit("entity-country").alias("relation"), F.lit("entity").alias("domain"), F.lit("country").alias("range"), "n"),
        e.agg(F.count("program").alias("n")).select(F.lit("entity-program"), F.lit("entity"), F.lit("program"), "n"),
        V.flows(spark, d, "orderkey").agg(F.count(F.lit(1)).alias("n")).select(F.lit("flow-dest"), F.lit("flow"), F.lit("country"), "n"),
    ]
    return rows[0].union(rows[1]).union(rows[2])


@query("a28_price_contrast", f"""with {V.PRICES}, l as (select *, max(year) over (partition by product) m from prices), k as (select *, count(*) filter (year = m) over (partition by product) c from l),
  u as (select *, row_number() over (partition by product order by price, country, year) lo, row_number() over (partition by product order by price desc, country, year) hi from k where c < 2 or year = m)
  select product, max(case when lo = 1 then country end) cheapest, min(price) low, max(case when hi = 1 then country end) dearest, max(price) high from u group by product""")
def a28(spark, d):
    return A.price_contrast(V.prices(spark, d), ["product"], "country", "year", "price")


@query("a29_share_of", f"with {V.FLOWS} select product, year, cast(sum(qty) as bigint) total, cast(coalesce(sum(case when origin = 'NATION_1' then qty end), 0) as bigint) part, floor(coalesce(sum(case when origin = 'NATION_1' then qty end), 0)::double / sum(qty)::double * 100 * 10 + 0.5) / 10 share_pct from flows group by all")
def a29(spark, d):
    return A.share_of(V.flows(spark, d, "product year qty origin"), ["product", "year"], "qty", F.col("origin") == "NATION_1")


@query("a30_coverage_by_year", f"with {V.LOAD} select year, count(*) records, max(c) most_months from (select site, country, year, count(distinct month) c from load group by all) group by year")
def a30(spark, d):
    each = A.mean_with_coverage(V.monthly_load(spark, d), ["site", "country", "year"], "rate", "month")
    return each.groupBy("year").agg(F.count(F.lit(1)).alias("records"), F.max("observed").alias("most_months"))


@query("a31_tier_counts", f"with {V.EVIDENCE} select {tier_sql('source_name', 'source_url')} tier, count(*) records, count(distinct source_name) names from inflows group by 1")
def a31(spark, d):
    f = V.inflows(spark, d).groupBy("source_name", "source_url").agg(F.count(F.lit(1)).alias("n"))
    return f.groupBy(reliability_tier(F.col("source_name"), F.col("source_url")).alias("tier")).agg(F.sum("n").alias("records"), F.countDistinct("source_name").alias("names"))

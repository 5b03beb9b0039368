"""Queries over time (W), ranks (K), sets (U) and scalar functions (F)."""

from pyspark.sql import functions as F

from corrob.functions import columns as C
from corrob.functions.columns import half_up
from corrob.functions.sources import HOST_SQL, family_label, family_sql, reliability_weight, source_family, tier_sql
from corrob.operators import aggregate as A
from corrob.operators import records as R
from corrob.operators import series as S
from corrob.plans import views as V
from corrob.plans.registry import query

YEARLY = V.FLOWS + ", yearly as (select dest, product, year, cast(sum(qty) as bigint) v from flows group by all)"


def yearly(spark, d):
    return V.flows(spark, d, "dest product year qty").groupBy("dest", "product", "year").agg(F.sum("qty").alias("v"))


@query("w1_trend_densified", f"with {V.FLOWS}, e as (select cust, year, cast(sum(qty) as bigint) v from flows where product = 'SMALL' group by all), y as (select distinct year from e) select c.cust, y.year, coalesce(e.v, 0) as \"value\" from (select distinct cust from e) c cross join y left join e on e.cust = c.cust and e.year = y.year")
def w1(spark, d):
    return S.densified(V.flows(spark, d, "cust year product qty").where("product = 'SMALL'"), ["cust"], "year", "qty")


@query("w2_latest_yoy", f"with {V.PRICES}, r as (select *, row_number() over (partition by product, country order by year desc) rn, lead(price) over (partition by product, country order by year desc) p from prices) select product, country, year latest, case when p <> 0 then floor((price - p) / p * 100 * 10 + 0.5) / 10 end change_pct from r where rn = 1")
def w2(spark, d):
    return S.latest_change(V.prices(spark, d), ["product", "country"], "year", "price")


@query("w3_rebased_index", f"with {YEARLY}, f as (select *, first_value(v) over (partition by dest, product order by year) b from yearly) select dest, product, year, v, case when b > 0 then floor(v::double / b * 100 * 10 + 0.5) / 10 end as \"index\" from f")
def w3(spark, d):
    return S.rebased(yearly(spark, d), ["dest", "product"], "year", "v")


MOMENTUM = "mom as (select region, year, sum(m) m from (select region, year, ha * 0.01::double + \"index\" * 10 m from stats union all select region, year, qty * 0.1::double from outflows) group by all)"


def momentum(spark, d):
    a = V.stats(spark, d).select("region", "year", (F.col("ha") * 0.01 + F.col("index") * 10).alias("m"))
    b = V.outflows(spark, d).select("region", "year", (F.col("qty") * 0.1).alias("m"))
    return a.unionByName(b).groupBy("region", "year").agg(F.sum("m").alias("m"))


TRAJECTORY = """traj as (select region, coalesce(max(case when year = 2000 then m end), 0) cur, max(case when year < 2000 then year end) baseline_year, arg_max(m, year) filter (year < 2000) base from mom where year <= 2000 group by region),
trajectories as (select region, case when base is null then 'insufficient-data' when base <= 0 then case when cur > 0 then 'rising' else 'insufficient-data' end when (cur - base) / base > 0.15 then 'rising' when (cur - base) / base < -0.15 then 'falling' else 'stable' end trajectory,
  case when base > 0 then floor((cur - base) / base * 1000 + 0.5) / 1000 end change_pct, baseline_year from traj)"""


@query("w4_trajectory", f"with {V.EVIDENCE}, {MOMENTUM}, {TRAJECTORY} select * from trajectories")
def w4(spark, d):
    return S.trajectory(momentum(spark, d), ["region"], "year", "m", 2000)


@query("w5_staleness", f"with {V.EVIDENCE}, e as (select region, year from stats where year < 1997 union all select region, year from conflicts where intensity > 98), g as (select region, max(year) latest from e where year <= 2000 group by region) select region, latest, 2000 - latest age, case when 2000 - latest >= 3 then 'stale' when 2000 - latest >= 1 then 'aging' else 'current' end staleness from g")
def w5(spark, d):
    return S.staleness([V.stats(spark, d).where("year < 1997"), V.conflicts(spark, d).where("intensity > 98")], ["region"], "year", 2000)


@query("w6_long_run_change", f"with {V.PRICES}, g as (select product, country, min(year) first_time, max(year) last_time, arg_min(price, year) f, arg_max(price, year) l, count(*) n from prices group by all) select product, country, first_time, last_time, f as \"first\", l as \"last\", case when f > 0 then floor((l - f) / f * 100 * 10 + 0.5) / 10 end change_pct from g where n >= 2")
def w6(spark, d):
    return S.long_run_change(V.prices(spark, d), ["product", "country"], "year", "price")


@query("w7_pivot_series", f"with {V.FLOWS} select cust, year, " + ", ".join(f"cast(sum(qty) filter (product = '{p}') as bigint) {p}" for p in ("ECONOMY", "LARGE", "SMALL")) + " from flows group by cust, year")
def w7(spark, d):
    return V.flows(spark, d, "cust year product qty").groupBy("cust", "year").pivot("product", ["ECONOMY", "LARGE", "SMALL"]).agg(F.sum("qty"))


@query("w8_trim_tail", f"with {V.OUTCOMES}, y as (select jurisdiction, year, cast(sum(deaths) as bigint) v from outcomes group by all), r as (select *, row_number() over w rn, lag(v) over w p from y window w as (partition by jurisdiction order by year)), l as (select *, max(case when rn <= 2 or v >= 0.6::double * p then rn end) over (partition by jurisdiction) last_ from r) select jurisdiction, year, v from l where rn <= last_")
def w8(spark, d):
    y = V.outcomes(spark, d).groupBy("jurisdiction", "year").agg(F.sum("deaths").alias("v"))
    return S.trim_incomplete_tail(y, ["jurisdiction"], "year", "v", 0.6)


@query("w9_trend_by_group", f"with {V.FLOWS}, e as (select item, year, sum(qty) v from flows where dest = 'NATION_2' group by all), y as (select distinct year from e), s as (select g.item, y.year, coalesce(e.v, 0) v from (select distinct item from e) g cross join y left join e on e.item = g.item and e.year = y.year), h as (select item, cast(arg_min(v, year) as bigint) f, cast(arg_max(v, year) as bigint) l, cast(sum(v) as bigint) total from s group by item) select item, f as \"first\", l as \"last\", total, case when f > 0 then floor((l - f)::double / f * 100 * 10 + 0.5) / 10 end change_pct from h where total > 0")
def w9(spark, d):
    return S.group_trends(V.flows(spark, d, "dest item year qty").where("dest = 'NATION_2'"), "item", "year", "qty")


_MOVE = "g as (select {k}, cast(sum(case when year = 1996 then qty end) as bigint) a, cast(sum(case when year = 2000 then qty end) as bigint) b from flows where year in (1996, 2000) group by {k})"


@query("w10_movers_abs", f"with {V.FLOWS}, {_MOVE.format(k='cust')} select cust, coalesce(a, 0) as \"before\", coalesce(b, 0) as \"after\", coalesce(b, 0) - coalesce(a, 0) change from g order by abs(coalesce(b, 0) - coalesce(a, 0)) desc, cust limit 20")
def w10(spark, d):
    return S.movers(V.flows(spark, d, "cust year qty"), ["cust"], "year", "qty", 1996, 2000).orderBy(F.desc(F.abs("change")), "cust").limit(20)


@query("w11_movers_rate", f"with {V.FLOWS}, {_MOVE.format(k='cust')} select cust, a as \"before\", b as \"after\", b - a change, floor((b - a)::double / a * 1000 + 0.5) / 1000 rate from g where a is not null and b is not null order by rate desc nulls last, cust limit 20")
def w11(spark, d):
    m = S.movers(V.flows(spark, d, "cust year qty"), ["cust"], "year", "qty", 1996, 2000, both=True)
    return m.withColumn("rate", half_up(F.col("change") / F.col("before"), 3)).orderBy(F.desc_nulls_last("rate"), "cust").limit(20)


@query("w12_state_trend", f"with {V.OUTCOMES}, p as (select n_name, count(*) pop from customer join nation on c_nationkey = n_nationkey group by n_name) select jurisdiction, year, product, deaths, floor(deaths * 100000::double / pop * 10 + 0.5) / 10 per_100k from outcomes join p on n_name = jurisdiction where not \"partial\"")
def w12(spark, d):
    pop = V.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("pop")).join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = V.outcomes(spark, d).where("not partial").join(pop, F.col("jurisdiction") == F.col("n_name"))
    return o.select("jurisdiction", "year", "product", "deaths", C.rate_per_100k(F.col("deaths"), F.col("pop")).alias("per_100k"))


@query("w13_union_axis", f"with {V.FLOWS}, a as (select 'ships' modality, year, cast(sum(qty) as bigint) v from flows where dest = 'NATION_1' and year >= 1997 group by year), b as (select 'orders' modality, cast(year(o_orderdate) as int) \"year\", count(*) v from orders where year(o_orderdate) <= 1999 group by all), u as (select * from a union all select * from b), m as (select distinct modality from u), y as (select distinct year from u) select m.modality, y.year, u.v from m cross join y left join u on u.modality = m.modality and u.year = y.year")
def w13(spark, d):
    a = V.flows(spark, d, "dest year qty").where("dest = 'NATION_1' and year >= 1997").groupBy("year").agg(F.sum("qty").alias("v")).withColumn("modality", F.lit("ships"))
    b = V.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("v")).where("year <= 1999").withColumn("modality", F.lit("orders"))
    u = a.unionByName(b)
    spine = u.select("year").distinct().select("year", F.explode(F.array(F.lit("ships"), F.lit("orders"))).alias("modality"))
    return spine.join(u, ["modality", "year"], "left").select("modality", "year", "v")


@query("w14_lookahead", r"""with l as (select doc_id, i pos, lines[i] line from (select doc_id, string_split(text, chr(10)) lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents)),
  m as (select *, nullif(regexp_extract(line, '^([A-Z]\w*)', 1), '') k, nullif(regexp_extract(line, '(\d+)', 1), '') v from l),
  w as (select *, lead(k, 1) over o k1, lead(k, 2) over o k2, lead(v, 1) over o v1, lead(v, 2) over o v2 from m window o as (partition by doc_id order by pos))
  select distinct doc_id, k as "key", coalesce(v, case when k1 is null then v1 end, case when k1 is null and k2 is null then v2 end) as "value" from w where k is not null and coalesce(v, case when k1 is null then v1 end, case when k1 is null and k2 is null then v2 end) is not null""")
def w14(spark, d):
    lines = V.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    part = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    return S.lookahead(lines, "doc_id", "pos", part(r"^([A-Z]\w*)"), part(r"(\d+)"))


@query("k1_top_products", f"with {V.FLOWS}, g as (select dest, item, cast(sum(qty) as bigint) total from flows where year = 1999 group by all), r as (select *, cast(row_number() over (partition by dest order by total desc, item) as int) as rank from g) select * from r where rank <= 8")
def k1(spark, d):
    g = A.totals_by(V.flows(spark, d, "dest item year qty"), ["dest", "item"], "qty", F.col("year") == 1999)
    return S.top_per(g, ["dest"], [F.desc("total"), F.col("item")], 8)


@query("k2_top_n_histogram", f"with {V.FLOWS}, g as (select item, count(*) n, arg_min(product, orderkey * 100000 + partkey) first_product from flows group by item) select item, n, first_product from g order by n desc, item limit 5")
def k2(spark, d):
    g = V.flows(spark, d, "item product orderkey partkey").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min_by("product", F.col("orderkey") * 100000 + F.col("partkey")).alias("first_product"))
    return g.orderBy(F.desc("n"), "item").limit(5)


@query("k3_rank_prices", f"with {V.PRICES} select product, country, year, floor(price / (purity / 100) * 100 + 0.5) / 100 adjusted from prices where purity > 0 and purity <= 100 and year = 2000 order by adjusted desc, product, country limit 15")
def k3(spark, d):
    p = V.prices(spark, d).where("year = 2000").withColumn("adjusted", half_up(C.purity_adjusted(F.col("price"), F.col("purity")), 2)).where("adjusted is not null")
    return p.select("product", "country", "year", "adjusted").orderBy(F.desc("adjusted"), "product", "country").limit(15)


@query("k5_priority_pick", "with r as (select *, row_number() over (partition by o_custkey order by case when o_orderpriority = '1-URGENT' and o_orderstatus = 'O' then 0 when o_orderpriority = '1-URGENT' then 1 when o_orderstatus = 'O' then 2 else 3 end, o_orderdate, o_orderkey) rn from orders) select o_custkey, o_orderkey, o_orderpriority, o_orderstatus from r where rn = 1")
def k5(spark, d):
    p, s = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "O"
    order = F.when(p & s, 0).when(p, 1).when(s, 2).otherwise(3)
    picked = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"), F.struct(order.alias("p"), "o_orderdate", "o_orderkey")).alias("o"))
    return picked.select("o_custkey", "o.*")


@query("k6_strongest_edges", f"with {V.FLOWS} select origin, dest, cast(sum(qty) as bigint) weight from flows group by all order by weight desc, origin, dest limit 14")
def k6(spark, d):
    return V.flows(spark, d, "origin dest qty").groupBy("origin", "dest").agg(F.sum("qty").alias("weight")).orderBy(F.desc("weight"), "origin", "dest").limit(14)


@query("u1_node_union", f"with {V.FLOWS} select distinct node from (select origin node from flows union all select dest from flows union all select r_name from region)")
def u1(spark, d):
    f = V.flows(spark, d, "origin dest")
    return f.select(F.col("origin").alias("node")).unionByName(f.select(F.col("dest").alias("node"))).unionByName(V.table(spark, d, "region").select(F.col("r_name").alias("node"))).distinct()


@query("u2_merge_notes", f"with {V.FLOWS}, n as (select dest, 1 k, 'heavy ' || item note from flows where qty >= 50 group by all union all select dest, 2, 'discount ' || product from flows where disc >= 10 group by all) select dest, string_agg(note, '; ' order by k, note) notes from n group by dest")
def u2(spark, d):
    f = V.flows(spark, d, "dest qty item disc product")
    a = f.where("qty >= 50").select("dest", F.lit(1).alias("k"), F.concat(F.lit("heavy "), "item").alias("note"))
    b = f.where("disc >= 10").select("dest", F.lit(2).alias("k"), F.concat(F.lit("discount "), "product").alias("note"))
    # Distinct notes of one region: as many as checks and their words, not as rows.
    g = a.unionByName(b).distinct().groupBy("dest").agg(F.array_sort(F.collect_list(F.struct("k", "note"))).alias("n"))
    return g.select("dest", F.array_join(F.transform("n", lambda x: x["note"]), "; ").alias("notes"))


@query("u3_route_legs", f"with {V.FLOWS}, s as (select list_filter([origin, case when supp % 2 = 0 then 'NATION_' || (supp % 25) end, dest], lambda x: x is not null) s from flows) select distinct s[i] a, s[i + 1] b from (select s, unnest(range(1, len(s))) i from s)")
def u3(spark, d):
    f = V.flows(spark, d, "origin dest supp")
    transit = F.when(F.col("supp") % 2 == 0, F.concat(F.lit("NATION_"), (F.col("supp") % 25).cast("string")))
    return f.select(F.explode(C.route_legs(F.col("origin"), transit, F.col("dest"))).alias("l")).select("l.a", "l.b").distinct()


@query("f9_route_legs", f"with {V.FLOWS}, s as (select product, list_filter([origin, case when supp % 3 = 0 then 'NATION_' || (size % 25) end, dest], lambda x: x is not null) s from flows) select product, s[i] || ' > ' || s[i + 1] leg, count(*) n from (select product, s, unnest(range(1, len(s))) i from s) group by all")
def f9(spark, d):
    """How often each product goes each leg; transit is known for a third of the lines."""
    transit = F.when(F.col("supp") % 3 == 0, F.concat(F.lit("NATION_"), (F.col("size") % 25).cast("string")))
    legs = V.flows(spark, d, "origin dest supp size product").select("product", F.explode(C.route_legs(F.col("origin"), transit, F.col("dest"))).alias("l"))
    return legs.groupBy("product", F.concat("l.a", F.lit(" > "), "l.b").alias("leg")).agg(F.count(F.lit(1)).alias("n"))


@query("u4_except_seen", """select event_id, user_id, event_type from events e where event_type <> 'click' and not exists (select 1 from events s where s.event_type = 'click' and s.user_id = e.user_id and cast(s.ts as date) = cast(e.ts as date))""")
def u4(spark, d):
    """Events of users on days on which the clicks haven't shown the user already."""
    e = V.table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    seen = e.where("event_type = 'click'").select("user_id", "day").distinct()
    return e.where("event_type <> 'click'").join(seen, ["user_id", "day"], "left_anti").select("event_id", "user_id", "event_type")


@query("u5_full_years", f"with {V.OUTCOMES} select distinct year from outcomes where not \"partial\"")
def u5(spark, d):
    return V.outcomes(spark, d).where("not partial").select("year").distinct()


@query("u6_duplicates", "select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
def u6(spark, d):
    return V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("f10_affordability", f"with {V.PRICES}, g as (select n_name, avg(c_acctbal) gdp from customer join nation on c_nationkey = n_nationkey group by n_name) select product, country, year, case when gdp > 0 then floor(price / (gdp / 365) * 100 + 0.5) / 100 end as \"days\" from prices left join g on n_name = country")
def f10(spark, d):
    gdp = V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.avg("c_acctbal").alias("gdp"))
    return V.prices(spark, d).join(gdp, "country", "left").select("product", "country", "year", half_up(C.affordability_days(F.col("price"), F.col("gdp")), 2).alias("days"))


@query("f12_scaled_positions", f"with {V.FLOWS}, g as (select dest, year, cast(sum(qty) as bigint) v from flows group by all), m as (select *, max(v) over () mx from g) select dest, year, v, floor((case when v > 0 and mx > 0 then least(1.0, log10(v + 1) / log10(mx + 1)) else 0.0 end) * 10000 + 0.5) / 10000 log_share, floor((case when v > 0 and mx > 0 then least(1.0, sqrt(v::double / mx)) else 0.0 end) * 10000 + 0.5) / 10000 ramp from m")
def f12(spark, d):
    g = V.flows(spark, d, "dest year qty").groupBy("dest", "year").agg(F.sum("qty").alias("v"))
    m = g.join(F.broadcast(g.agg(F.max("v").alias("mx"))), F.lit(True))  # one row
    v, mx = F.col("v").cast("double"), F.col("mx").cast("double")
    return m.select("dest", "year", "v", half_up(C.log_share(v, mx), 4).alias("log_share"), half_up(C.sqrt_ramp(v, mx), 4).alias("ramp"))


_KG = "case when t >= 1000 then printf('%.1f t', floor(t::double / 1000 * 10 + 0.5) / 10) when t >= 1 then printf('%.0f kg', t::double) else printf('%.0f g', t::double * 1000) end"


@query("f16_narratives", f"with {V.FLOWS}, g as (select dest, cast(sum(qty) as bigint) t, count(*) n from flows where year = 1997 group by dest), s0 as (select dest, product, sum(qty) q from flows where year = 1997 group by all), s as (select *, row_number() over (partition by dest order by q desc, product) rn from s0) select g.dest, printf('%d records report %s into %s; the largest part is %s.', n, {_KG}, g.dest, product) sentence from g join s on s.dest = g.dest and rn = 1")
def f16(spark, d):
    each = V.flows(spark, d, "dest product year qty").where("year = 1997").groupBy("dest", "product").agg(F.sum("qty").alias("q"), F.count(F.lit(1)).alias("n"))
    g = each.groupBy("dest").agg(F.sum("q").alias("t"), F.sum("n").alias("n"), F.min_by("product", F.struct(-F.col("q"), "product")).alias("p"))
    return g.select("dest", F.format_string("%d records report %s into %s; the largest part is %s.", "n", C.humanize_mass(F.col("t").cast("double")), "dest", "p").alias("sentence"))


@query("f17_qualifiers", "select o_orderkey, case o_orderkey % 4 when 0 then '≈' when 1 then '<' when 2 then '>' else '' end || cast(o_custkey as varchar) || ' kg' shown from orders")
def f17(spark, d):
    rel = F.element_at(F.array(*map(F.lit, ("approximate", "below", "above", "exact"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return V.table(spark, d, "orders").select("o_orderkey", F.concat(C.qualifier(rel), F.col("o_custkey").cast("string"), F.lit(" kg")).alias("shown"))


ACTORS = [("(?i)police|error", "state"), ("(?i)click|view", "ethnic_armed"), ("(?i)purchase", "militia")]


@query("f18_classify_actor", "select event_type, case when regexp_matches(event_type, '(?i)police|error') then 'state' when regexp_matches(event_type, '(?i)click|view') then 'ethnic_armed' when regexp_matches(event_type, '(?i)purchase') then 'militia' else 'unknown' end actor_type, count(*) n from events group by all")
def f18(spark, d):
    return V.table(spark, d, "events").groupBy("event_type", C.first_match(F.col("event_type"), ACTORS, F.lit("unknown")).alias("actor_type")).agg(F.count(F.lit(1)).alias("n"))


@query("f20_host_of", f"select page_id, {HOST_SQL.format(url='url')} host from pages")
def f20(spark, d):
    return V.table(spark, d, "pages").select("page_id", C.host_of(F.col("url")).alias("host"))


_NAMED = "n as (select *, case when i % 3 = 0 then upper(source_name) when i % 3 = 1 then source_name else '  ' || source_name || ' ' end name from (select c_custkey i, {0} from customer))"
NAMED = _NAMED.format(V._source_sql("c_custkey"))


def named(spark, d):
    name, url = V.source_columns(F.col("c_custkey"))
    i = F.col("c_custkey") % 3
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.when(i == 0, F.upper(name)).when(i == 1, name).otherwise(F.concat(F.lit("  "), name, F.lit(" "))).alias("name"), url.alias("url"))


@query("f21_reliability", f"with {NAMED} select i, {tier_sql('name', 'source_url')} tier, case {tier_sql('name', 'source_url')} when 'high' then 1.0 when 'medium' then 0.75 else 0.5 end::double weight from n")
def f21(spark, d):
    from corrob.functions.sources import reliability_tier

    n, u = F.col("name"), F.col("url")
    return named(spark, d).select("i", reliability_tier(n, u).alias("tier"), reliability_weight(n, u).alias("weight"))


@query("f22_source_family", f"with {NAMED} select family, count(*) n, count(distinct name) names from (select *, {family_sql('name', 'source_url')} family from n) group by family")
def f22(spark, d):
    return named(spark, d).groupBy(source_family(F.col("name"), F.col("url")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


@query("f22b_family_label", f"with {NAMED}, f as (select distinct {family_sql('name', 'source_url')} family from n) select family, case when starts_with(family, 'name:') then array_to_string(list_transform(string_split(substr(family, 6), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') else upper(replace(family, '-', ' ')) end as \"label\" from f")
def f22b(spark, d):
    f = named(spark, d).select(source_family(F.col("name"), F.col("url")).alias("family")).distinct()
    return f.select("family", family_label(F.col("family")).alias("label"))


@query("f24_origin_attribution", "with o as (select c_custkey, case when c_custkey % 3 = 0 then 'NATION_1/NATION_' || (c_custkey % 5) when c_custkey % 3 = 1 then 'NATION_1' else 'NATION_2 / NATION_3' end origin from customer) select c_custkey, case when not list_contains(p, 'NATION_1') then 'none' when len(p) = 1 then 'only' else 'joint' end attribution from (select c_custkey, list_distinct(list_transform(string_split(origin, '/'), lambda x: trim(x))) p from o)")
def f24(spark, d):
    k = F.col("c_custkey")
    origin = F.when(k % 3 == 0, F.concat(F.lit("NATION_1/NATION_"), (k % 5).cast("string"))).when(k % 3 == 1, "NATION_1").otherwise("NATION_2 / NATION_3")
    parts = F.array_distinct(F.transform(F.split(origin, "/"), lambda x: F.trim(x)))
    return V.table(spark, d, "customer").select("c_custkey", F.when(~F.array_contains(parts, "NATION_1"), "none").when(F.size(parts) == 1, "only").otherwise("joint").alias("attribution"))


@query("f28_content_key", "select conv_id, turn, sha256(concat(coalesce(cast(conv_id as varchar), ''), chr(31), coalesce(nullif(role, 'user'), ''), chr(31), coalesce(text, ''))) k from conversations")
def f28(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", C.content_key(F.col("conv_id"), F.nullif("role", F.lit("user")), F.col("text")).alias("k"))


@query("f29_row_hash", """select n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || case when n_regionkey = 0 then 'null' else n_regionkey::varchar end || '}') h from nation""")
def f29(spark, d):
    n = V.table(spark, d, "nation").select("n_regionkey", "n_name", "n_nationkey")
    n = n.withColumn("n_regionkey", F.nullif("n_regionkey", F.lit(0)))
    return n.select("n_nationkey", R.content_hash(R.row_json(*n.columns)).alias("h"))


@query("f31_phrase_match", f"with {V.ENTITIES} select entity, case when regexp_matches(program, 'URGENT') then 'name' else 'alias' end field from entities where regexp_matches(program, 'URGENT') or len(list_filter(countries, lambda c: regexp_matches(c, '_13$'))) > 0")
def f31(spark, d):
    e = V.entities(spark, d)
    hit = F.col("program").rlike("URGENT")
    alias = F.exists("countries", lambda c: c.rlike("_13$"))
    return e.where(hit | alias).select("entity", F.when(hit, "name").otherwise("alias").alias("field"))


@query("f32_reach", f"with {V.ENTITIES} select entity, cast(len(countries) as int) n from entities where len(countries) >= 5")
def f32(spark, d):
    return V.entities(spark, d).where("size(countries) >= 5").select("entity", F.size("countries").alias("n"))

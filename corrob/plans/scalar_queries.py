"""Queries of scalar functions (F) over whole tables: strings as feeds write them, read back to values."""

from pyspark.sql import functions as F

from corrob.functions import columns as C
from corrob.functions.columns import half_up
from corrob.functions.sources import confidence_weight
from corrob.plans import views as V
from corrob.plans.ingest_queries import RAW, raw_orders
from corrob.plans.registry import query


@query("f1_coercion", f"with {RAW} select line, num as \"number\", cast(floor(num + 0.5) as bigint) as \"whole\", country from raw")
def f1(spark, d):
    return raw_orders(spark, d).select("line", C.coerce_number(F.col("price")).alias("number"), C.coerce_int(F.col("price")).alias("whole"), C.coerce_string(F.col("country")).alias("country"))


@query("f2_clamp_pct", "select p_partkey, least(100, p_size * 3)::double pct from part")
def f2(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.clamp_pct(F.concat((F.col("p_size") * 3).cast("string"), F.lit("%"))).alias("pct"))


@query("f3_month", "select o_orderkey, case when o_orderkey % 11 = 0 then null else cast(month(o_orderdate) as bigint) end as \"month\" from orders")
def f3(spark, d):
    key, name = F.col("o_orderkey"), F.date_format("o_orderdate", "MMMM")
    shown = F.when(key % 3 == 0, name).when(key % 3 == 1, F.upper(F.left(name, F.lit(3)))).otherwise(F.month("o_orderdate").cast("string"))
    return V.table(spark, d, "orders").select("o_orderkey", C.coerce_month(F.when(key % 11 == 0, F.lit("n/a")).otherwise(shown)).alias("month"))


@query("f4_slug", "select p_partkey, trim(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^a-z0-9]+', '_', 'g'), '_') slug from part")
def f4(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("f5_parse_numeric", "select o_orderkey, round(o_totalprice, 2)::double price, cast(year(o_orderdate) as int) as \"year\" from orders")
def f5(spark, d):
    price = F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))
    return V.table(spark, d, "orders").select("o_orderkey", C.parse_numeric(price).alias("price"), C.parse_year(F.date_format("o_orderdate", "yyyy-MM")).alias("year"))


@query("f6_split_list", "select p_partkey, p_brand || '+' || p_type || '+' || p_size parts from part")
def f6(spark, d):
    text = F.concat(F.lit("["), "p_brand", F.lit("] ["), "p_type", F.lit("]; | "), F.col("p_size").cast("string"))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(C.split_list(text), "+").alias("parts"))


@query("f7_label_order", "select p_partkey, case when contains(lower(p_name), 'brand') then 'branded' when contains(lower(p_name), 'economy') then 'economy' else 'other' end as \"label\" from part")
def f7(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.first_match(F.col("p_name"), [("(?i)brand", "branded"), ("(?i)economy", "economy")], F.lit("other")).alias("label"))


@query("f8_synonym", "select o_orderkey, case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'high' when '5-LOW' then 'low' else 'unknown' end as \"term\" from orders")
def f8(spark, d):
    table = {"1_urgent": "high", "2_high": "high", "5_low": "low"}
    return V.table(spark, d, "orders").select("o_orderkey", C.synonym(F.col("o_orderpriority"), table, "unknown").alias("term"))


@query("f11_purity_adjusted", f"with {V.PRICES} select product, country, year, case when purity > 0 and purity <= 100 then floor(price / (purity / 100) * 100 + 0.5) / 100 end adjusted from prices")
def f11(spark, d):
    return V.prices(spark, d).select("product", "country", "year", half_up(C.purity_adjusted(F.col("price"), F.col("purity")), 2).alias("adjusted"))


@query("f15_humanize_mass", "select o_orderkey, case when o_custkey >= 1000 then printf('%.1f t', floor(o_custkey / 1000::double * 10 + 0.5) / 10) when o_custkey >= 1 then printf('%.0f kg', o_custkey::double) else printf('%.0f g', o_custkey * 1000::double) end shown from orders")
def f15(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", C.humanize_mass(F.col("o_custkey").cast("double")).alias("shown"))


@query("f19_serial_year", "select o_orderkey, cast(year(o_orderdate) as int) as \"year\" from orders")
def f19(spark, d):
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    return V.table(spark, d, "orders").select("o_orderkey", C.excel_serial_year(serial).alias("year"))


@query("f23_confidence_weight", f"with {V.EVIDENCE} select confidence, case confidence when 'official' then 1.0 when 'reported' then 0.78 else 0.55 end::double weight, count(*) n from inflows group by confidence")
def f23(spark, d):
    n = V.inflows(spark, d).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    return n.select("confidence", confidence_weight(F.col("confidence")).cast("double").alias("weight"), "n")


@query("f30_header", r"select p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace('avgPrice_' || p_brand || '%', '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[%_]', ' ', 'g'), '\s+', ' ', 'g')) as header from part")
def f30(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.normalized_header(F.concat(F.lit("avgPrice_"), "p_brand", F.lit("%"))).alias("header"))


@query("f13_rate_per_100k", """with p as (select c_nationkey, count(*) filter (c_acctbal > 0) pop from customer group by 1), n as (select c_nationkey, o_orderpriority, count(*) n from orders join customer on o_custkey = c_custkey group by all)
  select c_nationkey, o_orderpriority, case when pop > 0 then floor(n * 100000 / pop::double * 10 + 0.5) / 10 end rate from n join p using (c_nationkey)""")
def f13(spark, d):
    c = V.table(spark, d, "customer")
    pop = c.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("pop"))
    n = V.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.join(pop, "c_nationkey").select("c_nationkey", "o_orderpriority", C.rate_per_100k(F.col("n"), F.col("pop")).alias("rate"))


@query("f14_round_sig", """with v as (select event_id, case when event_type = 'error' then -"value" when event_type = 'click' then "value" / 1000000 when event_type = 'view' then 0.0 else "value" * 1234.5 end v from events)
  select event_id, case when v = 0 then 0.0 else floor(v * pow(10.0, 6 - ceil(log10(abs(v)))) + 0.5) / pow(10.0, 6 - ceil(log10(abs(v)))) end rounded from v""")
def f14(spark, d):
    e, v, kind = V.table(spark, d, "events"), F.col("value"), F.col("event_type")
    spread = F.when(kind == "error", -v).when(kind == "click", v / 1_000_000).when(kind == "view", F.lit(0.0)).otherwise(v * 1234.5)
    return e.select("event_id", C.round_sig(spread).alias("rounded"))

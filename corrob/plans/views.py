"""Record sets derived from the given tables, in DataFrame form and as SQL for the oracles (common table expressions)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corrob.functions.columns import half_up
from corrob.functions.sources import reliability_weight, source_family, tier_sql, family_sql, confidence_weight
from corrob.operators.rules import sized
from corrob.sources.shared import modified


@functools.lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str, changed: int) -> StructType:
    return spark.read.parquet(path).schema


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table. Its schema is read once, as a query may read a table several times, and again when the table has changed."""
    path = f"{d}/{name}.parquet"
    return spark.read.schema(_schema(spark, path, modified(spark, path))).parquet(path)


@functools.lru_cache(maxsize=256)
def _rows(spark: SparkSession, path: str, changed: int) -> int:
    return spark.read.schema(_schema(spark, path, changed)).parquet(path).count()


#: Tables of keys (suppliers, customers, parts) are broadcast up to so many rows; beyond, lines and orders are shuffled to meet them.
MOST = 1_000_000


def few(spark: SparkSession, d: str, name: str, df: DataFrame) -> DataFrame:
    """``df``, which has a row at most for each of the given table ``name``, to be broadcast if that has ``MOST`` rows at most. Rows are counted once, like schemas."""
    path = f"{d}/{name}.parquet"
    return F.broadcast(df) if _rows(spark, path, modified(spark, path)) <= MOST else df


def flows(spark: SparkSession, d: str, columns: str, parts: str | None = None) -> DataFrame:
    """One row per line with the ``columns`` named, of: origin and dest (nations), cust, supp, product, item, year, qty, cents, disc (percent), size, orderkey, partkey.

    Keys between the tables hold, so a table that gives none of the columns isn't joined at all. Lines carry no more than what is wanted of them; suppliers, customers and parts are broadcast
    where they are ``few``, customers meet orders before lines do, so that lines are shuffled once for orders and once for parts at most. ``parts``: a condition on product, item or size that few parts
    fulfil; those are counted by themselves and meet lines first, so that few lines are left for orders and, last, for customers.
    """
    t = lambda n, *c: table(spark, d, n).select(*c)
    wanted = set(columns.split())
    nation = t("nation", "n_nationkey", "n_name")
    made = {
        "supp": F.col("l_suppkey").alias("supp"), "partkey": F.col("l_partkey").alias("partkey"), "orderkey": F.col("l_orderkey").alias("orderkey"), "year": F.year("l_shipdate").alias("year"), "qty": F.col("l_quantity").cast("long").alias("qty"),
        "cents": F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "disc": F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
    }
    of_orders, of_parts = {"dest", "cust"} & wanted, {"product", "item", "size"} & wanted
    keys = ({"supp"} if "origin" in wanted else set()) | ({"partkey"} if of_parts or parts else set()) | ({"orderkey"} if of_orders else set())
    out = table(spark, d, "lineitem").select(*(c for name, c in made.items() if name in wanted | keys))
    if "origin" in wanted:
        supplier = t("supplier", "s_suppkey", "s_nationkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supp"), F.col("n_name").alias("origin"))
        out = out.join(few(spark, d, "supplier", supplier), "supp")
    part = t("part", F.col("p_partkey").alias("partkey"), F.col("p_type").alias("product"), F.col("p_brand").alias("item"), F.col("p_size").alias("size"))
    order = t("orders", F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("cust"))
    customer = t("customer", "c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cust"), F.col("n_name").alias("dest"))
    customer = few(spark, d, "customer", customer) if "dest" in wanted else None
    if parts:
        out = out.join(sized(part.where(parts).select("partkey", *sorted(of_parts)), MOST), "partkey")
    if of_orders and parts:
        out = out.join(order, "orderkey")
        out = out if customer is None else out.join(customer, "cust")
    elif of_orders:
        order = order if customer is None else order.join(customer, "cust")
        out = out.join(order.select("orderkey", *sorted(of_orders)), "orderkey")
    if of_parts and not parts:
        out = out.join(few(spark, d, "part", part.select("partkey", *sorted(of_parts))), "partkey")
    return out.select(*columns.split())


def orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customers and those customers' nations: orders are joined once, with what customers have, and not shuffled where these are ``few``."""
    nation = table(spark, d, "nation")
    customer = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # a row per nation
    return table(spark, d, "orders").join(few(spark, d, "customer", customer), F.col("o_custkey") == F.col("c_custkey"))


FLOWS = """flows as (select a.n_name origin, b.n_name dest, c_custkey cust, s_suppkey supp, p_type product, p_brand item, cast(year(l_shipdate) as int) "year",
  cast(l_quantity as bigint) qty, cast(round(l_extendedprice * 100) as bigint) cents, cast(round(l_discount * 100) as bigint) disc, p_size size, o_orderkey orderkey, l_partkey partkey
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join part on l_partkey = p_partkey join nation a on s_nationkey = a.n_nationkey join nation b on c_nationkey = b.n_nationkey)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """product, country, year, price (a unit), purity (percent), n: means over lines."""
    f = flows(spark, d, "product origin year cents qty disc").groupBy("product", F.col("origin").alias("country"), "year")
    return f.agg(half_up(F.sum("cents") / F.sum("qty") / 100, 2).alias("price"), half_up(100 - F.avg("disc"), 2).alias("purity"), F.count(F.lit(1)).alias("n"))


PRICES = FLOWS + """, prices as (select product, origin country, "year", floor(sum(cents)::double / sum(qty)::double / 100 * 100 + 0.5) / 100 price,
  floor((100 - sum(disc)::double / count(*)) * 100 + 0.5) / 100 purity, count(*) n from flows group by all)"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """jurisdiction, year, month (last of the window), partial, product (priority), deaths (orders)."""
    o = orders_by_nation(spark, d)
    last = F.when(F.year("o_orderdate") == 2001, 7).otherwise(12)
    return o.groupBy(F.col("n_name").alias("jurisdiction"), F.year("o_orderdate").alias("year"), last.alias("month"), F.col("o_orderpriority").alias("product")).agg(F.count(F.lit(1)).alias("deaths")).withColumn("partial", F.col("month") != 12)


OUTCOMES = """outcomes as (select n_name jurisdiction, cast(year(o_orderdate) as int) "year", cast(case when year(o_orderdate) = 2001 then 7 else 12 end as int) "month",
  o_orderpriority product, count(*) deaths, year(o_orderdate) = 2001 "partial" from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"""


def monthly_load(spark: SparkSession, d: str) -> DataFrame:
    """site (segment), country, year, month, rate: mean order value of the month."""
    o = orders_by_nation(spark, d)
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.groupBy(F.col("c_mktsegment").alias("site"), F.col("n_name").alias("country"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg((F.sum(cents) / F.count(F.lit(1)) / 100).alias("rate"))


LOAD = """load as (select c_mktsegment site, n_name country, cast(year(o_orderdate) as int) "year", cast(month(o_orderdate) as int) "month",
  sum(cast(round(o_totalprice * 100) as bigint))::double / count(*) / 100 rate from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    """entity (order), program (priority), kind (status), countries: the different nations of its suppliers."""
    f = flows(spark, d, "orderkey origin").groupBy("orderkey").agg(F.array_sort(F.collect_set("origin")).alias("countries"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("program"), F.col("o_orderstatus").alias("kind"))
    return o.join(f, F.col("o_orderkey") == F.col("orderkey"), "left").select(F.col("o_orderkey").alias("entity"), "program", "kind", F.coalesce("countries", F.array().cast("array<string>")).alias("countries"))


ENTITIES = FLOWS + """, entities as (select o_orderkey entity, o_orderpriority program, o_orderstatus kind, coalesce(cs, []) countries
  from orders left join (select orderkey, list_sort(list(distinct origin)) cs from flows group by orderkey) on o_orderkey = orderkey)"""

#: Eight source names and URLs, by key modulo 8; the last is unattributed.
SOURCES = (
    ("UNODC Annual Survey", "https://www.unodc.org/r"), ("unodc", "https://unodc.org/x"), ("INCB", "https://incb.org/a"), ("ACLED", "https://acleddata.com/b"),
    ("Field note", "https://notes.example.com/c"), ("Ministry Of  Health", "https://moh.gov:8080/d"), ("Reuters", "https://reuters.com/e"), (None, None),
)


def source_columns(key: Column) -> tuple[Column, Column]:
    name, url = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (n, u) in enumerate(SOURCES):
        name, url = F.when(key % 8 == i, F.lit(n)).otherwise(name), F.when(key % 8 == i, F.lit(u)).otherwise(url)
    return name, url


def _source_sql(key: str) -> str:
    q = lambda x: "null" if x is None else f"'{x}'"
    return ", ".join(f"case {key} % 8 " + " ".join(f"when {i} then {q(s[k])}" for i, s in enumerate(SOURCES)) + f" end {c}" for k, c in enumerate(("source_name", "source_url")))


def _facts(named: DataFrame) -> DataFrame:
    """n, u (name and URL), family, reliability of the sources ``named``."""
    n, u = F.col("source_name"), F.col("source_url")
    return named.select(n.alias("n"), u.alias("u"), source_family(n, u).alias("family"), reliability_weight(n, u).alias("reliability"))


@functools.lru_cache(maxsize=1)
def known_facts(spark: SparkSession) -> DataFrame:
    """The facts of SOURCES, decided once a session."""
    name, url = source_columns(F.col("id"))
    facts = _facts(spark.range(len(SOURCES)).select(name.alias("source_name"), url.alias("source_url")))
    return spark.createDataFrame(facts.collect(), facts.schema)  # eight rows


def with_source_facts(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Adds family and reliability: by ``facts``, or else decided once per source of ``df``, not once per row."""
    facts = _facts(df.select("source_name", "source_url").distinct()) if facts is None else F.broadcast(facts)
    return df.join(facts, df["source_name"].eqNullSafe(facts["n"]) & df["source_url"].eqNullSafe(facts["u"])).drop("n", "u")


def pair_flows(spark: SparkSession, d: str) -> DataFrame:
    """origin, dest, year, product, ki, ko (what sources of inflows and outflows go by), qty: lines meet the other tables once for both."""
    f = flows(spark, d, "origin dest year product supp cust qty")
    return f.groupBy("origin", "dest", "year", "product", (F.col("supp") % 7).alias("ki"), (F.col("cust") % 8).alias("ko")).agg(F.sum("qty").alias("qty"))


def inflows(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    """origin, region, year, product, source, confidence, qty; weighted = qty · confidence · reliability, in ten-thousandths, so that sums are exact. ``pairs``: ``pair_flows``, where they are there already."""
    name, url = source_columns(F.col("k"))
    f = flows(spark, d, "origin dest year product supp qty").withColumn("ki", F.col("supp") % 7) if pairs is None else pairs
    f = f.groupBy("origin", F.col("dest").alias("region"), "year", "product", F.col("ki").alias("k")).agg(F.sum("qty").alias("qty"))
    f = f.select("origin", "region", "year", "product", "qty", name.alias("source_name"), url.alias("source_url"), F.when(F.col("product").isin("ECONOMY", "SMALL"), "official").when(F.col("product").isin("MEDIUM", "LARGE"), "reported").otherwise("estimated").alias("confidence"))
    return with_source_facts(f, known_facts(spark)).withColumn("weighted", F.col("qty") * F.round(confidence_weight(F.col("confidence")) * F.col("reliability") * 10_000).cast("long"))


def outflows(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    """region, corridor, year, product, source (null: unattributed), qty."""
    name, url = source_columns(F.col("k"))
    f = flows(spark, d, "origin dest year product cust qty").withColumn("ko", F.col("cust") % 8) if pairs is None else pairs
    f = f.groupBy(F.col("origin").alias("region"), F.col("dest").alias("corridor"), "year", "product", F.col("ko").alias("k")).agg(F.sum("qty").alias("qty"))
    return with_source_facts(f.select("region", "corridor", "year", "product", "qty", name.alias("source_name"), url.alias("source_url")), known_facts(spark))


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    """region, year, actor, kind, source, intensity (0 to 100), from the event stream."""
    name, url = source_columns(F.col("event_id") % 7)
    e = table(spark, d, "events")
    out = e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("NATION_"), F.pmod("user_id", F.lit(25)).cast("string")).alias("region"), (1999 + F.pmod("event_id", F.lit(3))).cast("int").alias("year"),
        F.concat("event_type", F.lit("-"), F.pmod("user_id", F.lit(7)).cast("string")).alias("actor"), F.col("event_type").alias("kind"),
        F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.col("value")))).cast("long").alias("intensity"), name.alias("source_name"), url.alias("source_url"),
    )
    return with_source_facts(out, known_facts(spark))


def stats(spark: SparkSession, d: str) -> DataFrame:
    """region, year, ha, index: a region's own statistics; one region in six has none."""
    o = orders_by_nation(spark, d)
    out = o.where("n_nationkey % 6 <> 5").groupBy(F.col("n_name").alias("region"), "n_nationkey", F.year("o_orderdate").alias("year")).agg((F.count(F.lit(1)) * 10).alias("ha"))
    return out.select("region", "year", "ha", ((F.col("n_nationkey") * 37 + F.col("year")) % 101).cast("int").alias("index"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("region"), F.col("n_regionkey").alias("area"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """region, neighbor: nations of one area, but for themselves."""
    r = regions(spark, d)
    return r.join(r.withColumnRenamed("region", "neighbor"), "area").where("region <> neighbor").select("region", "neighbor")


EVIDENCE = FLOWS + f""", in0 as (select origin, dest region, "year", product, supp % 7 k, cast(sum(qty) as bigint) qty from flows group by all),
in1 as (select origin, region, "year", product, qty, {_source_sql("k")}, case when product in ('ECONOMY', 'SMALL') then 'official' when product in ('MEDIUM', 'LARGE') then 'reported' else 'estimated' end confidence from in0),
out0 as (select origin region, dest corridor, "year", product, cust % 8 k, cast(sum(qty) as bigint) qty from flows group by all),
out1 as (select region, corridor, "year", product, qty, {_source_sql("k")} from out0),
con1 as (select event_id id, 'NATION_' || (user_id % 25) region, cast(1999 + event_id % 3 as int) "year", event_type || '-' || (user_id % 7) actor, event_type kind,
  cast(least(100, greatest(0, floor("value"))) as bigint) intensity, {_source_sql("(event_id % 7)")} from events),
src as (select *, {family_sql("source_name", "source_url")} family, {tier_sql("source_name", "source_url")} tier from (select {_source_sql("k")} from range(8) t(k))),
inflows as (select i.*, family, case tier when 'high' then 1.0 when 'medium' then 0.75 else 0.5 end::double reliability,
  qty * cast((case confidence when 'official' then 1.0 when 'reported' then 0.78 else 0.55 end) * (case tier when 'high' then 1.0 when 'medium' then 0.75 else 0.5 end) * 10000 as bigint) weighted
  from in1 i join src on i.source_name is not distinct from src.source_name),
outflows as (select o.*, family, case tier when 'high' then 1.0 when 'medium' then 0.75 else 0.5 end::double reliability from out1 o join src on o.source_name is not distinct from src.source_name),
conflicts as (select c.*, family, case tier when 'high' then 1.0 when 'medium' then 0.75 else 0.5 end::double reliability from con1 c join src on c.source_name is not distinct from src.source_name),
stats as (select n_name region, cast(year(o_orderdate) as int) "year", count(*) * 10 ha, cast((n_nationkey * 37 + year(o_orderdate)) % 101 as int) "index"
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_nationkey % 6 <> 5 group by n_name, n_nationkey, year(o_orderdate)),
regions as (select n_name region, n_regionkey area from nation),
adjacency as (select a.region, b.region neighbor from regions a join regions b using (area) where a.region <> b.region)"""

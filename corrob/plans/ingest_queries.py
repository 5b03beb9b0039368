"""Queries of sources (S), validated ingest (P) and lookups (J). Dirty inputs are copies of the tables, spoilt by rule."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from corrob.functions import columns as C
from corrob.functions.columns import half_up
from corrob.operators import ingest as I
from corrob.operators import rules as L
from corrob.operators.aggregate import summable
from corrob.plans import views as V
from corrob.plans.aggregate_queries import AUDITED, audited
from corrob.plans.registry import query
from corrob.sources import files
from corrob.sources.shared import clear_at_exit, new_path

K = "o_orderkey"


def raw_orders(spark, d):
    """line and string fields of a dirty feed of orders; what is spoilt follows from the key."""
    k = F.col(K)
    drug = F.element_at(F.array(*map(F.lit, (" Cocaine", "heroin", "Opium ", "soap", "METHAMPHETAMINE"))), (k % 5 + 1).cast("int"))
    pre = F.element_at(F.array(*map(F.lit, ("Ephedrine", "acetic anhydride", "Safrole", "water"))), (k % 4 + 1).cast("int"))
    n = F.col("o_custkey").cast("string")
    number = F.when(k % 11 == 0, F.lit("n/a")).when(k % 11 == 1, F.concat(F.lit("-"), n)).when(k % 11 == 2, F.concat(n, F.lit("d"))).when(k % 11 == 3, F.lit("NaN")).when(k % 11 == 4, F.concat(n, F.lit(",5"))).otherwise(F.concat(n, F.lit(".5")))
    year = F.when(k % 13 == 0, F.lit("-")).otherwise(F.year("o_orderdate").cast("string"))
    return V.table(spark, d, "orders").select(
        k.alias("line"), drug.alias("drug"), pre.alias("precursor"), F.when(k % 17 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Land "), (k % 9).cast("string"))).alias("country"),
        F.lit("abc").alias("iso3"), F.lit("R").alias("region"), year.alias("year"), number.alias("price"), number.alias("quantity"), F.concat((k % 150).cast("string"), F.lit("%")).alias("purity"),
        F.concat(F.lit("Land "), (k % 9).cast("string")).alias("origin"), F.lit(None).cast("string").alias("transit"), F.when(k % 19 != 0, F.lit("Port A")).alias("destination"),
    )


_NUM = "case when o_orderkey % 11 = 0 then null when o_orderkey % 11 = 1 then -o_custkey::double when o_orderkey % 11 in (2, 3, 4) then null else o_custkey + 0.5::double end"
RAW = f"""raw as (select o_orderkey line, ['cocaine', 'heroin', 'opium', 'soap', 'methamphetamine'][o_orderkey % 5 + 1] drug, ['ephedrine', 'acetic_anhydride', 'safrole', 'water'][o_orderkey % 4 + 1] precursor,
  case when o_orderkey % 17 = 0 then null else 'Land ' || (o_orderkey % 9) end country, case when o_orderkey % 13 = 0 then null else cast(year(o_orderdate) as bigint) end "year", {_NUM} num, least(100, o_orderkey % 150)::double purity,
  'Land ' || (o_orderkey % 9) origin, case when o_orderkey % 19 <> 0 then 'Port A' end destination from orders)"""


def both(result):
    """Valid and rejected rows of a parser as one report: reason (null: accepted) by count."""
    valid, rejects = result
    return valid.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("reason"), "n").unionByName(rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@query("p1_validate_rejects", f"with {RAW} select line, 'Row ' || line || ': ' || r message from (select line, case when country is null or year is null or num is null then 'missing required fields' when drug = 'soap' then 'unknown drug' when num < 0 then 'negative price' end r from raw) where r is not null")
def p1(spark, d):
    return I.prices(raw_orders(spark, d))[1].select("line", "message")


@query("p3_prices", f"with {RAW} select line, drug, country, 'ABC' iso3, 'R' region, year, num price, purity from raw where country is not null and year is not null and num is not null and drug <> 'soap' and num >= 0")
def p3(spark, d):
    return I.prices(raw_orders(spark, d))[0]


def _report(missing: str, unknown: str, negative: str, source: str = RAW) -> str:
    return f"with {source}, m as (select case when {missing} then 'missing required fields' when {unknown} when {negative} else 'accepted' end reason from raw) select reason, count(*) n from m group by reason"


@query("p4_precursor_prices", _report("country is null or year is null or num is null", "precursor = 'water' then 'unknown precursor'", "num < 0 then 'negative price'"))
def p4(spark, d):
    return both(I.precursor_prices(raw_orders(spark, d)))


@query("p5_flows", _report("destination is null or year is null or num is null", "precursor = 'water' then 'unknown precursor'", "num < 0 then 'negative quantity'"))
def p5(spark, d):
    return both(I.flows(raw_orders(spark, d)))


@query("p6_nodes", """with raw as (select c_custkey k, 'customer_' || c_custkey id, c_acctbal / 100 lat, c_acctbal / 50 lng from customer), m as (select case when k % 10 = 0 then 'missing required fields' when not lat between -90 and 90 then 'lat out of range' when not lng between -180 and 180 then 'lng out of range' else 'accepted' end reason from raw) select reason, count(*) n from m group by reason""")
def p6(spark, d):
    k = F.col("c_custkey")
    c = V.table(spark, d, "customer")
    raw = c.select(k.alias("line"), F.lit(None).cast("string").alias("id"), F.when(k % 10 != 0, F.concat(F.lit("Customer "), k.cast("string"))).alias("label"), (F.col("c_acctbal") / 100).cast("string").alias("lat"), (F.col("c_acctbal") / 50).cast("string").alias("lng"))
    return both(I.nodes(raw))


@query("p7_region_stats", f"with {V.EVIDENCE}, s as (select s.*, case when r.region is null then true else false end unknown_region from (select *, case when ha % 7 = 0 then 'elsewhere' else lower(region) end rr from stats) s left join (select lower(region) region from regions) r on r.region = s.rr) select rr region, cast(year as bigint) \"year\", ha::double ha, least(100, \"index\" * 2)::double as \"index\", unknown_region from s where ha % 11 <> 0")
def p7(spark, d):
    raw = V.stats(spark, d).select(F.col("ha").alias("line"), F.when(F.col("ha") % 7 == 0, "elsewhere").otherwise(F.upper("region")).alias("region"), F.col("year").cast("string").alias("year"), F.when(F.col("ha") % 11 != 0, F.col("ha").cast("string")).otherwise("-").alias("ha"), F.concat((F.col("index") * 2).cast("string"), F.lit("%")).alias("index"))
    known = V.regions(spark, d).select(F.lower("region").alias("region"))
    return I.region_stats(raw, known)[0].drop("line")


@query("p8_regional_flows", f"with {V.EVIDENCE}, m as (select case when product = 'SMALL' then 'unknown product' else 'accepted' end reason from outflows) select reason, count(*) n from m group by reason")
def p8(spark, d):
    raw = V.outflows(spark, d).select(F.col("qty").alias("line"), F.col("region").alias("from"), F.col("corridor").alias("to"), F.col("year").cast("string").alias("year"), F.col("qty").cast("string").alias("quantity"), F.initcap("product").alias("product"), "source_name")
    syn = {p.lower(): p.lower() for p in ("ECONOMY", "LARGE", "MEDIUM", "STANDARD", "PROMO")}
    return both(I.regional_flows(raw, syn))


@query("p9_events", "with e as (select case when event_type = 'click' then 'ethnic_armed' when event_type = 'error' then 'state' else 'unknown' end actor_type, case when event_type = 'view' then 'battle' else 'other' end event_type, least(100, greatest(0, \"value\")) intensity from events) select actor_type, event_type, count(*) n, max(intensity) most from e group by all")
def p9(spark, d):
    e = V.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "Ethnic Armed-Group").when(F.col("event_type") == "error", " military ").otherwise("x")
    raw = e.select(F.col("event_id").alias("line"), F.lit("Shan North").alias("region"), F.lit("2024").alias("year"), F.lit("a").alias("actor"), kind.alias("actor_type"), F.when(F.col("event_type") == "view", "Battles").otherwise("gathering").alias("event_type"), F.col("value").cast("string").alias("intensity"))
    return I.events(raw)[0].groupBy("actor_type", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("intensity").alias("most"))


@query("p10_inflows", f"with {RAW} select case line % 3 when 0 then 'official' when 1 then 'estimated' else 'reported' end confidence, count(*) n, sum(num) quantity from raw where year is not null and num is not null and precursor <> 'water' and num >= 0 and destination is not null group by 1")
def p10(spark, d):
    raw = raw_orders(spark, d).withColumns({"to": F.col("destination"), "confidence": F.when(F.col("line") % 3 == 0, "OFFICIAL").when(F.col("line") % 3 == 1, "estimate").otherwise("rumour")})
    return I.inflows(raw)[0].groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("p11_mortality", f"""with {V.OUTCOMES}, r as (select *, case product when '1-URGENT' then 'opioids_all' when '2-HIGH' then 'synthetic_opioids' when '3-MEDIUM' then 'cocaine' when '5-LOW' then 'heroin' end s from outcomes),
  m as (select *, case when s is null then 'unknown substance' when deaths % 9 = 0 then 'suppressed or missing deaths' else 'accepted' end reason from r) select reason, \"partial\", s substance, count(*) n, cast(sum(case when reason = 'accepted' then deaths end) as double) deaths from m group by all""")
def p11(spark, d):
    o = V.outcomes(spark, d)
    label = F.when(F.col("product") == "1-URGENT", "Opioids (T40.0-T40.4)").when(F.col("product") == "2-HIGH", "Synthetic opioids, excl. methadone (T40.4)").when(F.col("product") == "3-MEDIUM", "Cocaine (T40.5)").when(F.col("product") == "5-LOW", "Heroin")
    raw = o.select(F.monotonically_increasing_id().alias("line"), "jurisdiction", F.col("year").cast("string").alias("year"), F.when(F.col("month") == 7, "July").alias("month"), F.coalesce(label, F.lit("Other")).alias("substance"), F.when(F.col("deaths") % 9 != 0, F.col("deaths").cast("string")).otherwise("").alias("deaths"), F.lit(None).cast("string").alias("predicted"))
    typed = raw.select("line", "jurisdiction", C.coerce_int(F.col("year")).alias("year"), F.coalesce(C.coerce_month(F.col("month")), F.lit(12).cast("long")).alias("month"), I.substance(F.col("substance")).alias("substance"), C.coerce_number(F.col("deaths")).alias("deaths"))
    marked = I.reasoned(typed, [I.required("jurisdiction", "year"), I.Rule(F.col("substance").isNull(), "unknown substance"), I.Rule(F.col("deaths").isNull(), "suppressed or missing deaths"), I.non_negative("deaths")])
    marked = marked.withColumn("reason", F.coalesce("reason", F.lit("accepted")))
    return marked.groupBy("reason", (F.col("month") != 12).alias("partial"), "substance").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("reason") == "accepted", F.col("deaths"))).alias("deaths"))


@query("p12_wastewater", _report("country is null or year is null or num is null", "drug = 'soap' then 'unknown drug'", "num < 0 then 'negative load'"))
def p12(spark, d):
    return both(I.wastewater(raw_orders(spark, d).withColumns({"site": F.lit("S"), "load": F.col("price")})))


@query("p13_designations", f"with {V.ENTITIES} select case when kind = 'P' then 'individual' else 'organization' end kind, kind <> 'P' kind_defaulted, count(*) n, cast(sum(len(countries)) as bigint) countries from entities where entity % 6 <> 0 group by all")
def p13(spark, d):
    e = V.entities(spark, d)
    raw = e.select(F.col("entity").alias("line"), F.lit("Name").alias("name"), F.when(F.col("kind") == "P", " Individual").otherwise(F.col("kind")).alias("kind"), F.when(F.col("entity") % 6 == 0, " ; ").otherwise(F.concat(F.lit("["), "program", F.lit("] [B]"))).alias("programs"), F.array_join("countries", " | ").alias("countries"))
    return I.designations(raw)[0].groupBy("kind", "kind_defaulted").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("countries").cast("long")).alias("countries"))


@query("p14_summable", f'with {AUDITED} select quantity_relation, eligibility, count(*) filter (ok) "summable", count(*) n from checked group by all')
def p14(spark, d):
    return audited(spark, d).groupBy("quantity_relation", "eligibility").agg(F.count_if(summable()).alias("summable"), F.count(F.lit(1)).alias("n"))


@query("p15_december_or_latest", "with e as (select distinct cast(year(o_orderdate) as int) \"year\", cast(month(o_orderdate) as int) \"month\", o_custkey from orders), l as (select max(year * 100 + month) m from e) select year, month, count(*) n from e, l where month = 12 or year * 100 + month = m group by all")
def p15(spark, d):
    e = V.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_custkey").distinct()
    return I.december_or_latest(e).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("p16_resolve_price", "with p as (select p_partkey, case when p_partkey % 3 = 0 then p_retailprice end t, case when p_partkey % 3 <> 2 then p_retailprice - 1 end l, case when p_partkey % 5 <> 1 then p_retailprice + 2 end h from part) select p_partkey, floor(coalesce(t, (l + h) / 2) * 100 + 0.5) / 100 price from p where coalesce(t, (l + h) / 2) is not null")
def p16(spark, d):
    k, v = F.col("p_partkey"), F.col("p_retailprice")
    price = I.resolve_price(F.when(k % 3 == 0, v), F.when(k % 3 != 2, v - 1), F.when(k % 5 != 1, v + 2))
    return V.table(spark, d, "part").select("p_partkey", half_up(price, 2).alias("price")).where("price is not null")


@query("p17_drop_unusable", f"with {RAW} select count(*) filter (year is not null and num >= 0) kept, count(*) filter (num is null) not_numeric, count(*) filter (num < 0) negative, count(*) filter (num >= 0 and year is null) incomplete from raw")
def p17(spark, d):
    r = raw_orders(spark, d).select(C.coerce_number(F.col("price")).alias("num"), C.coerce_int(F.col("year")).alias("year"))
    num, year = F.col("num"), F.col("year")
    return r.agg(F.count_if(year.isNotNull() & (num >= 0)).alias("kept"), F.count_if(num.isNull()).alias("not_numeric"), F.count_if(num < 0).alias("negative"), F.count_if((num >= 0) & year.isNull()).alias("incomplete"))


@query("p18_characteristic_filter", "with m as (select case when o_orderstatus <> 'F' then 'not a point estimate' when o_custkey % 20 = 0 then 'aggregate geography' when o_orderpriority = '5-LOW' then 'unmapped measure' when o_totalprice < 1000 then 'suppressed' else 'kept' end reason from orders) select reason, count(*) n from m group by reason")
def p18(spark, d):
    rules = [I.Rule(F.col("o_orderstatus") != "F", "not a point estimate"), I.Rule(F.col("o_custkey") % 20 == 0, "aggregate geography"), I.Rule(F.col("o_orderpriority") == "5-LOW", "unmapped measure"), I.Rule(F.col("o_totalprice") < 1000, "suppressed")]
    return I.reasoned(V.table(spark, d, "orders"), rules).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("p19_program_scope", f"with {V.ENTITIES} select entity, program from entities where list_contains([program, kind], '1-URGENT') and len(countries) > 3")
def p19(spark, d):
    e = V.entities(spark, d).withColumn("programs", F.array("program", "kind"))
    return e.where(F.array_contains("programs", "1-URGENT") & (F.size("countries") > 3)).select("entity", "program")


@query("p20_null_if_same", "select o_orderkey, nullif(o_custkey % 10, o_orderkey % 10) predicted from orders")
def p20(spark, d):
    return V.table(spark, d, "orders").select(K, F.nullif(F.col("o_custkey") % 10, F.col(K) % 10).alias("predicted"))


# --- sources


ALIASES = {"product": ["product", "product type"], "country": ["country", "nation"], "year": ["year", "yr"], "price": ["price usd per gram", "priceUsdPerGram"], "jurisdiction": ["state"]}


@query("s1_aliased_csv", f"with {V.PRICES} select product, country, cast(year as varchar) \"year\", price, country jurisdiction from prices")
def s1(spark, d):
    """Files of two layouts in one folder: columns in another order, under other names, with one that nobody knows."""
    at, p = new_path(spark, "csv"), V.prices(spark, d)
    p.where("year % 2 = 0").select(F.col("product").alias("Product_Type"), F.col("country").alias("Nation"), F.col("year").alias("YR"), F.col("price").alias("priceUsdPerGram")).write.csv(f"{at}/even", header=True)
    p.where("year % 2 = 1").select(F.col("price").alias("price % usd_per gram"), F.lit("x, y").alias("note"), F.col("year").alias("Year"), F.col("country"), F.col("product")).write.csv(f"{at}/odd", header=True)
    clear_at_exit(spark, at)
    out, _ = files.read_aliased_csv(spark, at, ALIASES, ["product", "year"], {"jurisdiction": "country"})
    return out.drop("file", "line").withColumn("price", C.coerce_number(F.col("price")))


FEED_ALIASES = {c: [c] for c in ("drug", "precursor", "country", "iso3", "region", "year", "price", "purity")}
FEED_ALIASES["drug"], FEED_ALIASES["price"], FEED_ALIASES["precursor"] = ["drug", "substance"], ["price", "usd per gram"], ["precursor", "chemical"]


def orders_feed(spark, d):
    """The dirty feed of orders as CSV: a file for each of 16 buckets, in three layouts, its lines by key; one layout has no year."""
    at, raw = new_path(spark, "feed"), raw_orders(spark, d).withColumn("bucket", F.col("line") % 16)
    layouts = {
        "plain": (raw["bucket"] < 8, ["drug", "precursor", "country", "iso3", "region", "year", "price", "purity"], {}),
        "turned": (raw["bucket"].between(8, 13), ["purity", "price", "year", "region", "note", "iso3", "country", "drug"], {"price": "Usd_per_Gram", "drug": "Substance"}),
        "yearless": (raw["bucket"] > 13, ["country", "drug", "price", "iso3", "region"], {}),
    }
    for name, (mine, columns, renamed) in layouts.items():
        rows = raw.where(mine).withColumn("note", F.lit('said "so", twice')).repartition("bucket").sortWithinPartitions("bucket", "line")
        rows.select("bucket", *(F.col(c).alias(renamed.get(c, c)) for c in columns)).write.partitionBy("bucket").csv(f"{at}/{name}", header=True, escape='"')
    clear_at_exit(spark, at)
    return at


_BUCKET = "try_cast(regexp_extract(file, 'bucket=([0-9]+)', 1) as long)"
_FED = f"{RAW}, fed as (select *, line % 16 bucket, row_number() over (partition by line % 16 order by line) + 1 at_line from raw), judged as (select *, case when country is null or year is null or num is null then 'missing required fields' when drug = 'soap' then 'unknown drug' when num < 0 then 'negative price' end r from fed where bucket < 14)"


@query("p1b_csv_rejects", f"with {_FED} select bucket, at_line line, 'Row ' || at_line || ': ' || r message from judged where r is not null")
def p1b(spark, d):
    records, _ = files.read_aliased_csv(spark, orders_feed(spark, d), FEED_ALIASES, ["drug", "country", "year", "price"])
    return I.prices(records)[1].select(F.expr(_BUCKET).alias("bucket"), "line", "message")


@query("s4_sharded_csv", "select o_orderkey, o_orderpriority, o_custkey from orders")
def s4(spark, d):
    at = new_path(spark, "shards")
    V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey").repartition(7).write.csv(at, header=True, quoteAll=True)
    return files.read_sharded_csv(spark, at, "o_orderkey long, o_orderpriority string, o_custkey long")


@query("s5_headerless", "select c_custkey, case when c_custkey % 3 <> 0 then c_mktsegment end segment from customer")
def s5(spark, d):
    at = new_path(spark, "headerless")
    V.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "-0- ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("segment")).write.csv(at, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_headerless(spark, at, "c_custkey long, segment string")


@query("s6_decode_dictionary", f"with {V.FLOWS} select origin, product, cast(sum(qty) as bigint) qty from flows group by all")
def s6(spark, d):
    f = V.flows(spark, d, "origin product orderkey qty")
    rows, products = files.encode_dictionary(f.withColumn("at", F.col("orderkey")), "product", "at")
    rows, origins = files.encode_dictionary(rows.withColumnRenamed("code", "product_code"), "origin", "at")
    coded = rows.withColumnRenamed("code", "origin_code").groupBy("product_code", "origin_code").agg(F.sum("qty").alias("qty"))
    return files.decode_dictionary(coded, {"product_code": products, "origin_code": origins})


@query("s7_encode_dictionary", "with f as (select p_brand, min(p_partkey) m from part group by p_brand) select p_brand, cast(row_number() over (order by m, p_brand) - 1 as int) code from f")
def s7(spark, d):
    return files.encode_dictionary(V.table(spark, d, "part"), "p_brand", "p_partkey")[1]


@query("s8_csv_export", f"with {V.ENTITIES} select cast(entity as varchar) entity, nullif(program, '') program, nullif(array_to_string(countries, '; '), '') countries from entities")
def s8(spark, d):
    at = new_path(spark, "export")
    files.export_csv(V.entities(spark, d).select("entity", "program", "countries"), at)
    return spark.read.csv(at, header=True, schema="entity string, program string, countries string", quote='"', escape='"')


@query("s9_load_bundle", f"with {RAW} select 'precursor_prices' dataset, count(*) filter (r is null) loaded, count(*) filter (r is not null) rejected from (select case when country is null or year is null or num is null or precursor = 'water' or num < 0 then 1 end r from raw) union all select 'prices', count(*) filter (r is null), count(*) filter (r is not null) from (select case when country is null or year is null or num is null or drug = 'soap' or num < 0 then 1 end r from raw)")
def s9(spark, d):
    raw = raw_orders(spark, d)
    return files.load_bundle({"prices": I.prices(raw), "precursor_prices": I.precursor_prices(raw)})


@query("s9b_feed_report", f"""with {_FED}, c as (select 'prices' dataset, 'loaded' kind, count(*) filter (r is null) n, null::bigint bucket, null::bigint line, null::varchar message from judged
  union all select 'prices', 'warning', null, bucket, at_line, 'Row ' || at_line || ': ' || r from judged where r is not null union all select distinct 'prices', 'warning', null::bigint, bucket, null::bigint, 'missing columns: year' from fed where bucket > 13
  union all select 'precursor_prices', 'loaded', 0, null, null, null union all select distinct 'precursor_prices', 'warning', null::bigint, bucket, null::bigint, 'missing columns: precursor' || case when bucket > 13 then ', year' else '' end from fed where bucket >= 8
  union all select 'precursor_prices', 'warning', null, bucket, at_line, 'Row ' || at_line || ': ' || q from (select *, case when country is null or year is null or num is null then 'missing required fields' when precursor = 'water' then 'unknown precursor' when num < 0 then 'negative price' end q from fed where bucket < 8) where q is not null
  union all select 'nodes', 'error', null, null, null, 'PATH_NOT_FOUND') select * from c where kind <> 'loaded' or dataset = 'prices' union all select 'precursor_prices', 'loaded', count(*), null, null, null from fed where bucket < 8 and country is not null and year is not null and num >= 0 and precursor <> 'water'""")
def s9b(spark, d):
    at = orders_feed(spark, d)
    _, report = files.load_feeds(spark, {
        "prices": files.Feed(at, FEED_ALIASES, ["drug", "country", "year", "price"], I.prices),
        "precursor_prices": files.Feed(at, FEED_ALIASES, ["precursor", "country", "year", "price"], I.precursor_prices),
        "nodes": files.Feed(f"{at}/none", {"id": ["id"]}, ["id"], I.nodes),
    })
    message = F.when(F.col("kind") == "error", F.regexp_extract("message", "PATH_NOT_FOUND", 0)).otherwise(F.col("message"))
    return report.select("dataset", "kind", "n", F.expr(_BUCKET).alias("bucket"), "line", message.alias("message"))


@query("s10_fallback_dataset", "select n_nationkey, n_name from nation")
def s10(spark, d):
    n = V.table(spark, d, "nation").select("n_nationkey", "n_name")
    return files.fallback_dataset(n.where("n_nationkey < 0"), n)


_YEARS = [1996, 1997, 1998, 1999]


@query("s11_unpivot_years", f"with {V.PRICES} select product, country, year, price as \"value\" from prices where year between 1996 and 1999 and price > 1500")
def s11(spark, d):
    wide = V.prices(spark, d).groupBy("product", "country").pivot("year", _YEARS).agg(F.max(F.when(F.col("price") > 1500, F.col("price").cast("string")).otherwise("-")))
    return files.unpivot_years(wide, ["product", "country"], [str(y) for y in _YEARS])


@query("s12_take_until_marker", """with m as (select o_custkey, o_orderkey, o_orderstatus, max(case when o_orderstatus = 'O' then 1 else 0 end) over w on_ from orders window w as (partition by o_custkey order by o_orderkey)),
  n as (select *, max(case when o_orderpriority = '5-LOW' and on_ = 1 and o_orderstatus <> 'O' then 1 else 0 end) over (partition by o_custkey order by o_orderkey) off_ from (select m.*, o_orderpriority from m join orders using (o_orderkey)))
  select o_custkey, o_orderkey from n where on_ = 1 and off_ = 0 and o_orderstatus <> 'O'""")
def s12(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return files.take_until_marker(o, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "O", F.col("o_orderpriority") == "5-LOW").select("o_custkey", "o_orderkey")


# --- lookups


@query("j1_price_purity", f"with {V.FLOWS} select a.*, b.purity from (select origin, product, year, floor(avg(cents) / 100 * 100 + 0.5) / 100 price from flows group by all) a left join (select origin, product, year, floor(avg(100 - disc) * 100 + 0.5) / 100 purity from flows where size < 3 group by all) b using (origin, product, year)")
def j1(spark, d):
    f, keys = V.flows(spark, d, "origin product year cents disc size"), ["origin", "product", "year"]
    return f.groupBy(*keys).agg(half_up(F.avg("cents") / 100, 2).alias("price")).join(f.where("size < 3").groupBy(*keys).agg(half_up(F.avg(100 - F.col("disc")), 2).alias("purity")), keys, "left")


@query("j2_small_dimension", "select s_suppkey, n_name from supplier left join nation on s_nationkey = n_nationkey and n_nationkey < 20")
def j2(spark, d):
    n = V.table(spark, d, "nation").where("n_nationkey < 20")
    return V.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("j3_collected_sides", f"with {V.FLOWS} select c_custkey, coalesce(array_to_string(cs, '|'), '') countries, coalesce(array_to_string(ps, '|'), '') products from customer left join (select cust, list_sort(list(distinct origin)) cs from flows where year = 1999 group by cust) a on a.cust = c_custkey left join (select cust, list_sort(list(distinct product)) ps from flows where year = 2000 group by cust) b on b.cust = c_custkey")
def j3(spark, d):
    f = V.flows(spark, d, "cust year origin product")
    side = lambda y, c, n: f.where(F.col("year") == y).groupBy(F.col("cust").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set(c)), "|").alias(n))
    out = V.table(spark, d, "customer").select("c_custkey").join(side(1999, "origin", "countries"), "c_custkey", "left").join(side(2000, "product", "products"), "c_custkey", "left")
    return out.fillna("", ["countries", "products"])


@query("j4_full_outer_movers", f"with {V.FLOWS} select coalesce(a.cust, b.cust) cust, coalesce(x, 0) x, coalesce(y, 0) y from (select cust, cast(sum(qty) as bigint) x from flows where year = 1996 group by cust) a full join (select cust, cast(sum(qty) as bigint) y from flows where year = 2000 group by cust) b on a.cust = b.cust")
def j4(spark, d):
    f = V.flows(spark, d, "cust year qty")
    at = lambda y, n: f.where(F.col("year") == y).groupBy("cust").agg(F.sum("qty").alias(n))
    return at(1996, "x").join(at(2000, "y"), "cust", "full").fillna(0, ["x", "y"])


@query("j5_known_ids", "select c_custkey, n_nationkey is null unknown_nation from customer left join (select n_nationkey from nation where n_nationkey % 7 <> 3) on n_nationkey = c_nationkey")
def j5(spark, d):
    known = V.table(spark, d, "nation").where("n_nationkey % 7 <> 3")
    return I.flag_unknown(V.table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), "nation", known, "n_nationkey").select("c_custkey", "unknown_nation")


@query("j7_population_rate", f"with {V.OUTCOMES}, p as (select n_name, count(*) pop from customer join nation on c_nationkey = n_nationkey group by n_name) select jurisdiction, cast(sum(deaths) as bigint) deaths, floor(sum(deaths)::double * 100000 / pop * 10 + 0.5) / 10 rate from outcomes join p on n_name = jurisdiction group by jurisdiction, pop")
def j7(spark, d):
    pop = V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("jurisdiction")).agg(F.count(F.lit(1)).alias("pop"))
    o = V.outcomes(spark, d).groupBy("jurisdiction").agg(F.sum("deaths").alias("deaths"))
    return o.join(pop, "jurisdiction").select("jurisdiction", "deaths", C.rate_per_100k(F.col("deaths"), F.col("pop")).alias("rate"))


@query("j9_label_fallback", "select s_suppkey, coalesce(n_name, cast(s_nationkey as varchar)) label from supplier left join (select * from nation where n_nationkey % 4 <> 0) on n_nationkey = s_nationkey")
def j9(spark, d):
    n = V.table(spark, d, "nation").where("n_nationkey % 4 <> 0")
    return V.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("label"))


@query("j14_resolution_chain", "select c_custkey, coalesce(a.n_name, b.n_name, case when c_nationkey = 9 then 'manual nine' end) resolved, case when a.n_name is not null then 'id' when b.n_name is not null then 'alias' when c_nationkey = 9 then 'manual' else 'unmatched' end how from customer left join (select * from nation where n_nationkey < 5) a on a.n_nationkey = c_nationkey left join (select * from nation where n_nationkey < 9) b on b.n_nationkey = c_nationkey")
def j14(spark, d):
    n = V.table(spark, d, "nation").select("n_nationkey", "n_name")
    steps = {"id": n.where("n_nationkey < 5"), "alias": n.where("n_nationkey < 9"), "manual": n.where("n_nationkey = 9").withColumn("n_name", F.lit("manual nine"))}
    c = V.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    for how, t in steps.items():
        c = c.join(t.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias(how)), "c_nationkey", "left")
    how = reduce(lambda acc, h: F.when(F.col(h).isNotNull(), h).otherwise(acc), reversed(list(steps)), F.lit("unmatched"))
    return c.select("c_custkey", F.coalesce(*steps).alias("resolved"), how.alias("how"))


@query("j15_rule_join", "with r(o, p, v) as (values (1, 'ink', 'a'), (2, 'ing$', 'b'), (3, '^(red|blue)', 'c')) select p_partkey, coalesce(arg_min(v, o), 'none') as \"rule\" from part left join r on regexp_matches(p_name, p) group by p_partkey")
def j15(spark, d):
    rules = [("ink", "a"), ("ing$", "b"), ("^(red|blue)", "c")]
    return V.table(spark, d, "part").select("p_partkey", C.first_match(F.col("p_name"), rules, F.lit("none")).alias("rule"))


@query("j15b_phrase_rules", r"""with w as (select item_id, string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') w from benchmark where text is not null), p as (select item_id, array_to_string(w[1:2], ' ') literal, array_to_string(w[1:3], ' ') longer, len(w) n from w),
  r as (select row_number() over (order by item_id) "rule", literal, case when n >= 3 then longer end longer from p where literal <> '') select doc_id, "rule" from documents join r on contains(text, case when "rule" % 2 = 0 and longer is not null then longer else literal end)""")
def j15b(spark, d):
    """The first words of all benchmark items as rules over all documents: half of them as they are, half as patterns that want the third word too."""
    b = V.table(spark, d, "benchmark").where("text is not null").select("item_id", F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ").alias("w"))
    b = b.select("item_id", F.array_join(F.slice("w", 1, 2), " ").alias("literal"), F.when(F.size("w") >= 3, F.array_join(F.slice("w", 1, 3), " ")).alias("longer")).where("literal <> ''")
    rules = b.withColumn("rule", F.row_number().over(Window.orderBy("item_id")).cast("long"))  # a row an item
    quoted = F.regexp_replace("longer", r"([^\p{L}\p{N} ])", r"\\$1")
    return L.pattern_hits(V.table(spark, d, "documents"), "doc_id", "text", rules.withColumn("pattern", F.when((F.col("rule") % 2 == 0) & F.col("longer").isNotNull(), quoted)))


_PAGE = r"lower(regexp_extract(url, '://([^/?#]+)', 1)) host, coalesce(nullif(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), ''), '/') path"


@query("j17_longest_prefix_rule", rf"""with u as (select page_id, {_PAGE} from pages), r as (select host, page_id seq, case page_id % 3 when 0 then '*' when 1 then 'collect' else 'other' end agent, case when page_id % 2 = 0 then 'disallow' else 'allow' end type, substr(path, 1, 1 + page_id % 9) prefix from u where host <> ''),
  b as (select host, prefix, arg_min(type, seq) type from r where agent <> 'other' group by all), m as (select page_id, arg_max(type, len(prefix)) type from u join b on u.host = b.host and starts_with(path, prefix) group by page_id)
  select page_id, coalesce(type <> 'disallow', true) allowed from u left join m using (page_id)""")
def j17(spark, d):
    """Each page gives its host a rule: the beginning of its path, for all agents, for this one or for another."""
    path = F.coalesce(F.nullif(F.regexp_extract("url", "://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))
    u = V.table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host"), path.alias("path"))
    agent = F.element_at(F.array(*map(F.lit, ("*", "collect", "other"))), (F.col("page_id") % 3 + 1).cast("int"))
    type_ = F.when(F.col("page_id") % 2 == 0, "disallow").otherwise("allow")
    rules = u.where("host <> ''").select("host", F.col("page_id").alias("seq"), agent.alias("agent"), type_.alias("type"), F.expr("substr(path, 1, cast(1 + page_id % 9 as int))").alias("path"))
    return L.decide_paths(u, rules, "Collector/1.0").select("page_id", "allowed")


@query("j18_mapped_population", "select s_suppkey, count(c_custkey) n, count(c_custkey) = 0 missing from supplier left join customer on c_nationkey = s_nationkey and c_nationkey <> 4 group by s_suppkey")
def j18(spark, d):
    pop = V.table(spark, d, "customer").where("c_nationkey <> 4").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    s = V.table(spark, d, "supplier").join(pop, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return s.select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))

"""Operators on hand-made records with values worked out by hand."""

import re
import time

import pytest
from pyspark.sql import functions as F

from corrob.functions import columns as C
from corrob.functions.columns import extract_items, normalize_body, strip_tags
from corrob.functions.sources import reliability_tier, source_family
from corrob.operators import aggregate as A
from corrob.operators import fusion as R
from corrob.operators import graph as G
from corrob.operators import ingest as I
from corrob.operators import quality as Q
from corrob.operators import rules as L
from corrob.operators import series as S
from corrob.operators import text as N
from corrob.operators import triangulate as T
from corrob.plans.views import with_source_facts
from corrob.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "value"), [("1.5", 1.5), (" 2 ", 2.0), ("1d", None), ("NaN", None), ("Infinity", None), ("1,200", None), ("-", None), ("n/a", None), ("", None), ("-5", -5.0), ("1e3", 1000.0), ("0x10", None)])
def test_coerce_number(spark, text, value):
    assert one(spark, C.coerce_number(F.lit(text))) == value


def test_rounding_goes_up_at_halves(spark):
    assert one(spark, C.half_up_int(F.lit(-2.5))) == -2 and one(spark, C.half_up_int(F.lit(76.5))) == 77 and one(spark, C.round_sig(F.lit(123456.789))) == 123457.0
    assert one(spark, C.round_sig(F.lit(0.0))) == 0.0


def test_small_columns(spark):
    assert one(spark, C.slug(F.lit("Shan North"))) == "shan_north" and one(spark, C.coerce_month(F.lit("Feb"))) == 2 and one(spark, C.clamp_pct(F.lit("120%"))) == 100.0
    assert one(spark, C.split_list(F.lit("[A] [B]; C | "))) == ["A", "B", "C"] and one(spark, C.purity_adjusted(F.lit(100.0), F.lit(50.0))) == 200.0
    for purity in (None, 0.0, -5.0, 150.0):
        assert one(spark, C.purity_adjusted(F.lit(100.0), F.lit(purity).cast("double"))) is None
    legs = one(spark, C.route_legs(F.lit("a"), F.lit(None).cast("string"), F.lit("c")))
    assert [tuple(x) for x in legs] == [("a", "c")]
    assert one(spark, C.host_of(F.lit("https://WWW.Moh.gov:8080/x"))) == "www.moh.gov" and one(spark, C.host_of(F.lit("not a url"))) is None
    assert one(spark, C.content_key(F.lit("a"), F.lit(None).cast("string"))) != one(spark, C.content_key(F.lit("a")))


def pages_of(spark, *htmls):
    return spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id int, url string, html string")


def test_fingerprints_ignore_volatile_parts(spark):
    a, b = "<p>Run  123456 today</p>", "<p>Run\u00a0999999   today</p>"
    items = "<b>Two</b><b>One</b>", "x <b>One</b> y <B class='q'>Two</B>"
    got = [r[1] for r in N.page_fingerprints(pages_of(spark, a, b, *items, None, ""), "b").orderBy("page_id").collect()]
    assert got[0] == got[1] != got[2] and got[2] == got[3] and got[4] == got[5]


def test_items_have_the_class_asked_for(spark):
    html = (
        '<article class="report">One <b>two</b></article><article>Three</article><article id=1 class="x report y">Four &amp; five</article>'
        '<article dataclass="report">Six</article><article class="reporting">Seven</article><article class="a.b">Nine</article><article class="axb">Ten</article><article class="report>Eight</article>'
    )
    assert one(spark, C.extract_items(F.lit(html), "article", "report")) == ["One two", "Four & five"]
    assert one(spark, C.extract_items(F.lit(html), "article", "a.b")) == ["Nine"]


def test_markup_hides_no_keyword(spark):
    """Items come first, tags go before anything is measured, and a limit cuts the text last."""
    long = f'<p title="{"x" * 30_000}">A track record of 12345</p>'
    script = "<script>track</script><article>Quiet</article>"
    rows = {(r["page_id"], r["keyword"]): r for r in N.keyword_observations(pages_of(spark, long, script, "a " * 15_000 + "track"), ["Track"], "article").collect()}
    assert set(rows) == {(0, "Track"), (2, "Track")} and rows[0, "Track"]["excerpt"] == "A track record of #" and rows[0, "Track"]["item_sha"] == ""
    assert N.keyword_observations(pages_of(spark, long, "a " * 15_000 + "track"), ["Track"], most=20_000).count() == 1
    # The same items in another order are the same observation; another keyword isn't.
    one_, two = "<article>ab</article><article>cd track</article>", "<article>cd track</article> new <article>ab</article>"
    prints = [r["fingerprint"] for r in N.keyword_observations(pages_of(spark, one_, two), ["track", "ab"], "article").collect()]
    assert len(prints) == 4 and len(set(prints)) == 2


def test_hash_chain_of_a_long_chain(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    df = spark.range(30_000).selectExpr("id % 2 c", "id o", "cast(id as string) t")
    rows = {(r["c"], r["o"]): r for r in N.hash_chain(df, "c", "o", F.col("t")).collect()}
    prev = ""
    for i in range(1, 30_000, 2):
        assert rows[1, i]["previous_hash"] == prev
        prev = sha(prev + sha(str(i)))
        assert rows[1, i]["hash"] == prev


def test_source_rules(spark):
    tier = lambda n, u=None: one(spark, reliability_tier(F.lit(n).cast("string"), F.lit(u).cast("string")))
    fam = lambda n, u=None: one(spark, source_family(F.lit(n).cast("string"), F.lit(u).cast("string")))
    assert (tier("UNODC survey"), tier("Reuters"), tier("blog"), tier("x", "https://moh.gov/a"), tier(None)) == ("high", "medium", "low", "high", "low")
    assert fam("unodc") == fam("UNODC Annual") == fam("anything", "https://www.unodc.org/x") == "unodc" and fam("Ministry Of  Health ") == "name:ministry of health"
    assert fam(None) == "unknown" and fam("ap") == "name:ap" and fam("AP wire") == "ap"


def test_header_plan_and_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_text('State,YR,Data_Value,note\n"Al ""a""",2020,5,x\n')
    out, warnings = files.read_aliased_csv(spark, str(tmp_path / "a.csv"), {"jurisdiction": ["state"], "country": ["country"], "year": ["yr"], "deaths": ["data value"]}, ["jurisdiction", "year"], {"country": "jurisdiction"})
    assert [tuple(r)[1:] for r in out.collect()] == [(2, 'Al "a"', 'Al "a"', "2020", "5")] and warnings.count() == 0
    none, warnings = files.read_aliased_csv(spark, str(tmp_path / "a.csv"), {"site": ["site"]}, ["site"])
    assert none.count() == 0 and [r["message"] for r in warnings.collect()] == ["missing columns: site"]


def test_ingest_reasons(spark):
    raw = spark.createDataFrame(
        [(1, "Cocaine", "Colombia", "COL", "SA", "2023", "45.5", "78.5"), (2, "cocaine", "X", "X", "X", "2023", "not_a_number", "-"), (3, "cocaine", "X", "X", "X", "2023", "-5", ""), (4, "tea", "X", "X", "X", "2023", "1", None), (5, "heroin", "X", "X", "X", "2023", "2", "n/a")],
        "line int, drug string, country string, iso3 string, region string, year string, price string, purity string",
    )
    valid, rejects = I.prices(raw)
    assert [(r["line"], r["purity"]) for r in valid.orderBy("line").collect()] == [(1, 78.5), (5, None)]
    assert {r["line"]: r["message"] for r in rejects.collect()} == {2: "Row 2: missing required fields", 3: "Row 3: negative price", 4: "Row 4: unknown drug"}
    events = spark.createDataFrame([(1, "Shan North", "2024", "a", "militia", "territory", "120")], "line int, region string, year string, actor string, actor_type string, event_type string, intensity string")
    r = I.events(events)[0].first()
    assert (r["region"], r["event_type"], r["intensity"]) == ("shan_north", "territorial_control", 100.0)
    deaths = spark.createDataFrame([(1, "CA", "2023", "February", "Opioids (T40.0-T40.4)", "5", "5"), (2, "CA", "2023", None, "Synthetic opioids, excl. methadone (T40.4)", "", None)], "line int, jurisdiction string, year string, month string, substance string, deaths string, predicted string")
    valid, rejects = I.mortality(deaths)
    assert valid.first()["partial"] and valid.first()["predicted"] is None and valid.first()["substance"] == "opioids_all"
    assert rejects.first()["reason"] == "suppressed or missing deaths"


@pytest.mark.parametrize(("values", "index", "tier"), [([5], 10000, "concentrated"), ([1] * 8, 1250, "diversified"), ([1] * 5, 2000, "moderate"), ([60, 40], 5200, "concentrated"), ([0, 0], None, "insufficient-data")])
def test_hhi(spark, values, index, tier):
    df = spark.createDataFrame([("r", f"k{i}", v) for i, v in enumerate(values)], "r string, k string, v long")
    row = A.hhi(df, ["r"], "k", "v").withColumn("t", A.concentration_tier(F.col("hhi"))).first()
    assert (row["hhi"], row["t"]) == (index, tier)


def test_series(spark):
    s = spark.createDataFrame([("a", 2018, 100.0), ("a", 2021, 120.0), ("b", 2018, 0.0), ("b", 2019, 5.0), ("c", 2018, 1.0)], "k string, y int, v double")
    assert {r["k"]: r["change_pct"] for r in S.latest_change(s, ["k"], "y", "v").collect()} == {"a": 20.0, "b": None, "c": None}
    assert {(r["k"], r["y"]): r["index"] for r in S.rebased(s, ["k"], "y", "v").collect()}[("b", 2019)] is None
    tail = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate((100, 90, 80, 20))] + [("q", 0, 100.0), ("q", 1, 20.0)], "k string, y int, v double")
    assert sorted((r["k"], r["v"]) for r in S.trim_incomplete_tail(tail, ["k"], "y", "v").collect()) == [("p", 80.0), ("p", 90.0), ("p", 100.0), ("q", 20.0), ("q", 100.0)]


def _evidence(spark, ha, conflict, inflows, outflows, adjacency=()):
    facts = lambda rows, schema: with_source_facts(spark.createDataFrame(rows, schema))
    regions = spark.createDataFrame([("shan_north",), ("kachin",)], "region string")
    stats = spark.createDataFrame([(r, 2024, h, x) for r, h, x in ha], "region string, year int, ha double, index double")
    c = facts([(r, 2024, "A", "battle", v, "ACLED", None) for r, v in conflict], "region string, year int, actor string, kind string, intensity double, source_name string, source_url string")
    i = facts([("X", r, 2024, "p", q, s, None) for r, q, s in inflows], "origin string, region string, year int, product string, qty double, source_name string, source_url string").withColumn("weighted", F.col("qty") * F.col("reliability"))
    o = facts([(r, "gate", 2024, "d", q, s, None) for r, q, s in outflows], "region string, corridor string, year int, product string, qty double, source_name string, source_url string")
    return R.Evidence(regions, stats, c, i, o, spark.createDataFrame(list(adjacency), "region string, neighbor string"))


def test_briefing_ranking(spark):
    e = _evidence(spark, [("shan_north", 10000.0, 90.0), ("kachin", 5000.0, 20.0)], [("shan_north", 80.0)], [("shan_north", 4000.0, "INCB")], [("shan_north", 3000.0, None)])
    got = {r["region"]: r for r in R.risk_briefing(e, 2024).collect()}
    assert (got["shan_north"]["risk_score"], got["kachin"]["risk_score"]) == (93, 9) and (got["shan_north"]["confidence_score"], got["kachin"]["confidence_score"]) == (73, 27)
    assert (got["shan_north"]["source_diversity"], got["kachin"]["source_diversity"]) == (2, 0) and got["kachin"]["verification"] == "unverified"


def test_spillover_and_fragility(spark):
    both = [("shan_north", "kachin"), ("kachin", "shan_north")]
    e = _evidence(spark, [("shan_north", 20000.0, 95.0), ("kachin", 500.0, 5.0)], [("shan_north", 90.0)], [("shan_north", 5000.0, "INCB")], [], both)
    got = {r["region"]: r for r in R.risk_briefing(e, 2024).collect()}
    assert (got["shan_north"]["risk_score"], got["kachin"]["risk_score"]) == (77, 1) and got["kachin"]["spillover_watch"] and not got["shan_north"]["spillover_watch"] and got["kachin"]["neighbor"] == "shan_north"
    e = _evidence(spark, [("shan_north", 20000.0, 95.0)], [("shan_north", 90.0)], [("shan_north", 5000.0, "INCB"), ("shan_north", 100.0, "Unrecognized")], [])
    r = R.risk_briefing(e, 2024).where("region = 'shan_north'").first()
    assert (r["risk_score"], r["fragile"], r["fragile_family"], r["fragile_drop"]) == (77, True, "incb", 25)


def test_disagreement(spark):
    df = with_source_facts(spark.createDataFrame([("r", 1000.0, "UNODC", None), ("r", 4000.0, "blog", None), ("s", 1.0, "UNODC", None), ("s", 9.0, "unodc", None)], "region string, qty double, source_name string, source_url string"))
    assert [tuple(r) for r in R.disagreement(df, ["region"], "qty").collect()] == [("r", 2, 2000.0, 100)]


CASES = [
    ((100, 50), None, None, "untriangulated"), ((100, 50), (100, 200), None, "concordantExpansion"), ((50, 100), (200, 100), None, "concordantContraction"), ((100, 101), (100, 200), None, "undetectedExpansion"),
    ((100, 40), (100, 101), None, "enforcementArtifact"), ((100, 105), (100, 104), None, "concordantContraction"), ((100, 101), (100, 200), (200, 100), "undetectedExpansion"), ((100, 200), (100, 101), None, "mixedSignals"),
]


def test_verdicts(spark):
    pairs = spark.createDataFrame([(f"c{i}", "p") for i in range(len(CASES))], "country string, product string")
    table = lambda k: spark.createDataFrame([(f"c{i}", "p", y, float(v)) for i, c in enumerate(CASES) if c[k] for y, v in zip((2019, 2023), c[k])], "country string, product string, year int, v double")
    none = table(0).limit(0)
    r = T.readings(pairs, "seizures", none, 2023, 2019, zero_is_absent=True)
    for m, k in (("retail_price", 0), ("wastewater", 1), ("mortality", 2)):
        r = r.unionByName(T.readings(pairs, m, table(k), 2023, 2019))
    got = {x["country"]: x for x in T.triangulate(T.wide(r)).collect()}
    assert [got[f"c{i}"]["verdict"] for i in range(len(CASES))] == [c[3] for c in CASES]
    assert got["c6"]["fragile_modality"] == "wastewater" and not got["c1"]["fragile"] and got["c1"]["minimum_coverage"]
    assert one(spark, T.direction(T.relative_change(F.lit(100 * (1 + 0.15)), F.lit(100.0)))) == 0


def test_graph(spark):
    ent = lambda rows: spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, cs array<string>")
    edges = lambda rows: {(r["a"], r["b"]): r["weight"] for r in G.co_occurrence(ent(rows), "cs")[1].collect()}
    assert edges([["M"], ["M"], ["C"]]) == {} and len(edges([["B", "C", "L"]])) == 3 and edges([["A", "B"], ["B", "A"]]) == {("A", "B"): 2} and edges([["M", "M"]]) == {}
    chain = G.co_occurrence(ent([["A", "B"], ["B", "C"]]), "cs")[1]
    assert {r["node"]: r["betweenness"] for r in G.betweenness(chain).collect()} == {"A": 0.0, "B": 1.0, "C": 0.0}
    assert {r["node"]: r["articulation"] for r in G.articulation_points(chain).collect()} == {"A": False, "B": True, "C": False}
    square = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("D", "A"), ("X", "Y")], "a string, b string")
    assert {r["node"]: r["betweenness"] for r in G.betweenness(square).collect()} == {"A": 0.5, "B": 0.5, "C": 0.5, "D": 0.5, "X": 0.0, "Y": 0.0}
    assert not any(r["articulation"] for r in G.articulation_points(square).collect())


def test_search(spark):
    df = spark.createDataFrame([(1, "ZHAO, Wei", ["Wei Chao"]), (2, "Roman Zhao", [])], "id int, name string, aliases array<string>")
    asked = lambda q: spark.createDataFrame([(1, q)], "q int, said string")
    find = lambda q: [tuple(r)[1:] for r in L.search_names(L.name_index(df, "id", "name", "aliases"), asked(q), "q", "said").collect()]
    assert find("Wei  Chao ") == [(1, "Wei Chao")] and find("zhao roman") == [(2, None)] and find("Zhao Romans") == [] and find("a") == []


def test_chain_and_histories(spark):
    rows = N.hash_chain(spark.createDataFrame([("c", 1, "x"), ("c", 2, "y")], "c string, o int, t string"), "c", "o", F.col("t")).orderBy("o").collect()
    assert rows[0]["previous_hash"] == "" and rows[1]["previous_hash"] == rows[0]["hash"]
    h = spark.createDataFrame([("d", "h1", 1), ("d", "h2", 2)], "c string, h string, t int")
    c = spark.createDataFrame([("d", "h2", 3), ("d", "h1", 3), ("d", "h3", 1), ("d", "h4", 3), ("e", "h1", 1)], "c string, h string, t int")
    assert {(r["c"], r["h"]): r["outcome"] for r in Q.append_revision(h, c, "c", "h", "t").collect()} == {("d", "h2"): "no-op", ("d", "h1"): "replay", ("d", "h3"): "backwards", ("d", "h4"): "append", ("e", "h1"): "append"}


def test_intensity(spark):
    df = spark.createDataFrame([("a", 16), ("a", 0), ("a", 0), ("b", 0)], "k string, f long")
    got = {r["k"]: r["intensity"] for r in A.event_intensity(df, ["k"], F.col("f")).collect()}
    assert got["a"] == 45 and got["b"] == 10


def test_forbidden_columns(spark):
    df = spark.sql("select 1 id, named_struct('email', 'x', 'in', array(named_struct('phone', 1))) p")
    assert sorted(Q.forbidden_columns(df, {"email", "phone"})) == ["p.email", "p.in.phone"]


@pytest.mark.parametrize("unit", ["<", "<b", "<script>", "<script ", "<style>", "<b>", "<b class='x'>", "</b", "x", ">", "<>"])
def test_page_patterns_take_linear_time(spark, unit):
    """A megabyte of what never closes; the text that stays is what plain patterns leave of it."""
    n = 1_000_000 // len(unit)
    df = spark.createDataFrame([(unit * n,), (unit * 3 + "</script> a</b> >é " + unit * 3,)], "t string")
    start = time.time()
    rows = df.select("t", strip_tags(F.col("t")).alias("s"), normalize_body(F.col("t")).alias("n"), F.size(extract_items(F.col("t"), "b")).alias("i"), F.size(extract_items(F.col("t"), "b", "x")).alias("k")).collect()
    assert time.time() - start < 15
    short = rows[1]
    assert short["s"] == re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", short["t"])).strip()
    assert short["n"] == re.sub(r"\s+", " ", re.sub(r"(?is)<style.*?</style>", " ", re.sub(r"(?is)<script.*?</script>", " ", short["t"]))).strip()


def test_a_rewritten_table_is_read_with_its_new_columns(spark, tmp_path):
    from corrob.plans import views as V

    spark.range(3).selectExpr("id a").write.parquet(f"{tmp_path}/nation.parquet")
    assert V.table(spark, str(tmp_path), "nation").columns == ["a"]
    time.sleep(0.05)
    spark.range(3).selectExpr("id b", "id c").write.mode("overwrite").parquet(f"{tmp_path}/nation.parquet")
    assert V.table(spark, str(tmp_path), "nation").columns == ["b", "c"] and V.table(spark, str(tmp_path), "nation").count() == 3

"""What queries shuffle and how often they work a value out, as rows grow."""

from pyspark.sql import functions as F

from corrob.operators import ingest as I
from corrob.operators import rules as L
from corrob.plans import views as V
from corrob.plans.catalog import QUERIES
from corrob.sources import files
from corrob.streaming import summaries

SF = "/root/testdata/sf0.01"


def shuffled(spark, df):
    """Rows written to shuffles while what ``df`` makes is worked out."""
    sc = spark.sparkContext

    def so_far():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        doubles = sc._gateway.new_array(sc._jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, doubles, sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = so_far()
    df().write.format("noop").mode("overwrite").save()
    return sum(n for at, n in so_far().items() if at not in before)


def test_equal_names_and_queries_meet_once(spark):
    entities = spark.range(2000).select("id", F.concat(F.lit("Red "), F.element_at(F.array(F.lit("Ring"), F.lit("Bolt")), (F.col("id") % 2 + 1).cast("int"))).alias("name"), F.array().cast("array<string>").alias("aliases"))
    queries = spark.range(300).select(F.col("id").alias("q"), F.when(F.col("id") % 3 == 0, "ring-RED").when(F.col("id") % 3 == 1, "bolt, red").otherwise("red").alias("said"))
    find = lambda: L.search_names(L.name_index(entities, "id", "name", "aliases"), queries, "q", "said")
    assert find().count() == 100 * 1000 + 100 * 1000 + 100 * 2000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert 0 < shuffled(spark, find) < 20_000  # not a row for each of the 400,000 results
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_shuffled_once_a_table(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines, orders = (V.table(spark, SF, t).count() for t in ("lineitem", "orders"))
        assert 0 < shuffled(spark, lambda: QUERIES["w9_trend_by_group"](spark, SF)) < 1.5 * lines + orders
        assert 0 < shuffled(spark, lambda: QUERIES["t1_readings"](spark, SF)) < 3.6 * lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_readings_shuffle_lines_of_the_years_compared(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = V.table(spark, SF, "lineitem").count()
        for name in ("t1_readings", "t2_absent_reason", "t6_coverage_conflict", "t7_caveats", "t9_scan_divergences", "t10_precomputed_divergence"):
            assert 0 < shuffled(spark, lambda: QUERIES[name](spark, SF)) < 0.7 * lines, name
        monkeypatch.setattr(V, "MOST", 0)  # as if every table were too long to be broadcast
        assert 0 < shuffled(spark, lambda: QUERIES["t1_readings"](spark, SF)) < 2 * lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_value_is_worked_out_once_a_row(spark, tmp_path):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "a.csv").write_text("drug,country,year,price\n" + "soap,Land,1999,3\n" * 3)
    names = ["drug", "country", "iso3", "region", "year", "price", "purity"]
    records, _ = files.read_aliased_csv(spark, str(tmp_path), {c: [c] for c in names}, ["drug"])
    rejects = I.prices(records)[1]
    assert plan(rejects).lower().count("csvtostructs") + plan(rejects).lower().count("from_csv") == 1
    assert [r["message"] for r in rejects.orderBy("line").collect()] == [f"Row {i}: unknown drug" for i in (2, 3, 4)]
    judged = summaries.judged(spark.createDataFrame([("{}",)], "record string"), "record", summaries.Contract("a", "b", "c"))
    assert plan(judged).lower().count("parse_json") + plan(judged).lower().count("parsejson") == 1
    assert len(judged.first()["reasons"]) > 10

"""Every query with SQL agrees with DuckDB on the smallest tables; every other one runs."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from corrob.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name not in ORACLE:
        return
    got = con.execute(ORACLE[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """Tables where one product lacks the years that readings compare, one country has a product in other years only, another product has no lines, and some dates are missing."""
    at = tmp_path_factory.mktemp("gaps")
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
        if p.stem not in ("lineitem", "documents", "pages", "embeddings", "labels", "conversations", "benchmark"):
            c.execute(f"copy {p.stem} to '{at}/{p.name}' (format parquet)")
    c.execute(f"""copy (select l.* replace (case when l_orderkey % 50 = 0 or p_type = 'LARGE' and l_orderkey % 3 = 0 then null else l_shipdate end as l_shipdate)
      from lineitem l join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
      where p_type <> 'SMALL' and not (year(l_shipdate) in (1996, 2000) and (p_type in ('LARGE', 'PROMO') or s_nationkey = 3 and p_type = 'ECONOMY'))) to '{at}/lineitem.parquet' (format parquet)""")
    con = duckdb.connect()
    for p in at.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return str(at), con


@pytest.mark.parametrize("most", [1_000_000, 0])
@pytest.mark.parametrize("name", ["t1_readings", "t2_absent_reason", "t6_coverage_conflict", "t7_caveats", "t9_scan_divergences", "t10_precomputed_divergence"])
def test_readings_with_gaps(spark, gaps, monkeypatch, name, most):
    monkeypatch.setattr("corrob.plans.views.MOST", most)
    d, con = gaps
    df = QUERIES[name](spark, d)
    cols = sorted(df.columns)
    got = con.execute(ORACLE[name])
    names = [x[0] for x in got.description]
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()]
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert rows and sorted(rows, key=repr) == sorted(want, key=repr)
    if name == "t2_absent_reason":
        reasons = {r["reason"] for r in QUERIES[name](spark, gaps[0]).collect() if r["modality"] == "retail_price"}
        assert reasons == {"product not reported", "year not reported"}

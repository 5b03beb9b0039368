"""Streaming backfills over tables of many files that aren't in order of event time."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corrob.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["i4_hourly_snapshot", "i7_weekly_rollup"])
def test_backfill_counts_every_row_of_shuffled_files(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(12):
        events.where(F.col("event_id") % 12 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = con.execute(ORACLE[name])
    names = [x[0] for x in got.description]
    plain = lambda row: tuple(x if isinstance(x, str) else round(float(x), 9) for x in row)
    assert sorted(map(plain, QUERIES[name](spark, str(tmp_path)).select(*names).collect())) == sorted(map(plain, got.fetchall()))

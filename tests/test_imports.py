"""Imports that stop between two writes and go on, observations against earlier runs, summaries with every failure named."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from corrob.operators import text as N
from corrob.streaming import imports as P
from corrob.streaming import summaries as S

SCHEMA = "source string, at long, record string"


def add(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in.parquet")


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).parquet(f"{folder}/in.parquet")


def imported(spark, folder, run="run", before_receipts=lambda: None):
    return P.import_snapshots(stream(spark, folder), "source", F.col("record"), ["at"], f"{folder}/state", run, before_receipts)


def kept(table):
    return sorted((r["source"], r["place"][0]) for r in table.read().collect())


def test_unchanged_records_leave_no_trace(spark, tmp_path):
    add(spark, tmp_path, [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x"), ("b", 1, None), (None, 1, "n")])
    snapshots, receipts = imported(spark, tmp_path)
    want = [("a", "1"), ("a", "3"), ("a", "4")]
    assert kept(snapshots) == want == kept(receipts)
    add(spark, tmp_path, [("a", 5, "x"), ("a", 6, "z"), ("c", 1, "x")])
    snapshots, receipts = imported(spark, tmp_path)
    want += [("a", "6"), ("c", "1")]
    assert kept(snapshots) == want == kept(receipts)
    assert receipts.read().where("recovered").count() == 0


def fail():
    raise OSError("stopped")


@pytest.mark.parametrize("run", ["run", "other"])
def test_a_stopped_import_is_finished_on_restart(spark, tmp_path, run):
    """Stopped between snapshot and receipt: restarted from the same checkpoint, or from none."""
    add(spark, tmp_path, [("a", 1, "x"), ("b", 1, "y")])
    with pytest.raises(Exception, match="stopped"):
        imported(spark, tmp_path, before_receipts=fail)
    state = P.Table(spark, f"{tmp_path}/state/snapshots", "source string, place array<string>")
    assert kept(state) == [("a", "1"), ("b", "1")]
    for _ in range(2):
        snapshots, receipts = imported(spark, tmp_path, run)
        assert kept(snapshots) == kept(receipts) == [("a", "1"), ("b", "1")]
        assert all(r["recovered"] for r in receipts.read().collect())
    add(spark, tmp_path, [("a", 2, "x"), ("b", 2, "z")])
    snapshots, receipts = imported(spark, tmp_path, run)
    assert kept(snapshots) == kept(receipts) == [("a", "1"), ("b", "1"), ("b", "2")]
    assert [r["source"] for r in receipts.read().where("not recovered").collect()] == ["b"]


def test_half_written_batches_are_written_anew(spark, tmp_path):
    t = P.Table(spark, f"{tmp_path}/t", "v long")
    assert t.read().count() == 0
    assert t.write("b1", spark.range(3).select(F.col("id").alias("v"))) and not t.write("b1", spark.range(9).select(F.col("id").alias("v")))
    (tmp_path / "t" / "batch=b1" / "_SUCCESS").unlink()
    assert t.write("b1", spark.range(2).select(F.col("id").alias("v"))) and t.read().count() == 2 and t.read(without="b1").count() == 0


def test_runs_over_overlapping_pages_suppress_what_was_seen(spark, tmp_path):
    schema = "page_id long, url string, html string"
    find = lambda df: N.keyword_observations(df, ["storm", "river"])
    add(spark, tmp_path, [(1, "u1", "<p>storm</p>"), (2, "u2", "river and storm"), (3, "u2", "river and storm"), (4, None, None)], schema)
    seen, counts = P.observe(stream(spark, tmp_path, schema), find, f"{tmp_path}/state", "monday")
    assert [tuple(r) for r in counts.read().select("run", "found", "suppressed").collect()] == [("monday", 5, 2)] and seen.read().count() == 3
    add(spark, tmp_path, [(5, "u1", "storm"), (6, "u3", "storm"), (7, "u1", "storm and more")], schema)
    seen, counts = P.observe(stream(spark, tmp_path, schema), find, f"{tmp_path}/state", "tuesday")
    got = counts.read().where("run = 'tuesday'").agg(F.sum("found"), F.sum("suppressed")).first()
    assert tuple(got) == (8, 6) and seen.read().count() == 5 == seen.read().select("fingerprint").distinct().count()
    seen, counts = P.observe(stream(spark, tmp_path, schema), find, f"{tmp_path}/state", "tuesday")  # nothing new
    assert seen.read().count() == 5 and counts.read().agg(F.sum("found")).first()[0] == 13


CONTRACT = S.Contract("summary/v1", "monitor", "analysts")
GOOD = {
    "schema_version": "summary/v1", "producer": "monitor", "data_classification": "PRIVATE_ANALYST_REVIEW", "review_status": "HUMAN_REVIEW_REQUIRED", "publication_eligible": False, "intended_consumers": ["analysts", "others"],
    "window": {"start": "2026-01-01T00:00:00Z", "end": "2026-01-02T00:00:00.25Z", "complete": True},
    "sampling_frame": {"surface": S.SURFACE, "universal_telegram_coverage": False, "raw_messages_included": False, "exact_iocs_included": False, "source_identifiers_included": False},
    "coverage": {"messages_observed": 50, "messages_flagged": 4, "sources_observed": 5, "collection_errors": 0},
    "detections": {"status": "AVAILABLE_FOR_REVIEW", "minimum_messages": 20, "minimum_sources": 2, "tier_counts": {"WATCH": 3, "CLEAN": 47}, "family_counts": {"Überweisung a/b": 2}},
    "limitations": ["unverified"],
}
FAULTS = [
    (("extra",), 1, ["summary: keys"]), (("producer",), None, ["summary: keys", "producer: unknown"]), (("producer",), 7, ["producer: unknown"]), (("publication_eligible",), "false", ["publication_eligible: not false"]),
    (("publication_eligible",), True, ["publication_eligible: not false"]), (("intended_consumers",), ["analysts", 3], ["intended_consumers: not for us"]), (("intended_consumers",), "analysts", ["intended_consumers: not for us"]),
    (("window", "start"), "2026-01-01 00:00", ["window.start: no ISO-8601 UTC timestamp"]), (("window", "start"), "2026-02-30T00:00:00Z", ["window.start: no real timestamp"]), (("window", "end"), "2025-01-01T00:00:00Z", ["window: end doesn't follow start"]),
    (("window", "complete"), 1, ["window.complete: no boolean"]), (("window", "more"), {}, ["window: keys"]), (("sampling_frame", "surface"), "all", ["sampling_frame.surface: not approved"]), (("sampling_frame", "raw_messages_included"), True, ["sampling_frame.raw_messages_included: not false"]),
    (("coverage", "messages_observed"), 50.5, ["coverage.messages_observed: no count"]), (("coverage", "messages_observed"), "50", ["coverage.messages_observed: no count"]), (("coverage", "collection_errors"), -1, ["coverage.collection_errors: no count"]), (("coverage", "collection_errors"), 2**53, ["coverage.collection_errors: no count"]),
    (("coverage", "collection_errors"), 2.0, []), (("coverage", "messages_flagged"), 51, ["coverage: more flagged than observed"]), (("coverage",), [1], ["coverage: keys", *(f"coverage.{f}: no count" for f in S.KEYS["coverage"])]),
    (("detections", "status"), "NEW", ["detections.status: unknown"]), (("detections", "minimum_messages"), 0, ["detections.minimum_messages: no positive count"]), (("detections", "minimum_sources"), 6, ["detections: coverage too small"]), (("detections", "tier_counts", "SURE"), 0, ["detections.tier_counts: unknown name"]),
    (("detections", "tier_counts", "WATCH"), 4, ["detections.tier_counts: more than observed"]), (("detections", "family_counts", "-x"), 1, ["detections.family_counts: unknown name"]), (("detections", "family_counts", "constructor"), 1, ["detections.family_counts: unknown name"]), (("detections", "family_counts", "x"), {"y": 1}, ["detections.family_counts: no count"]),
    (("detections", "family_counts"), {f"f{i}": 1 for i in range(101)}, ["detections.family_counts: more than 100 entries"]), (("detections", "family_counts"), [], ["detections.family_counts: no object"]), (("detections", "status"), "INSUFFICIENT_COVERAGE", ["detections: counts not suppressed"]),
    (("limitations",), [], ["limitations: no list of one to 20 texts"]), (("limitations",), ["a", " "], ["limitations: no list of one to 20 texts"]), (("limitations",), ["x" * 501], ["limitations: no list of one to 20 texts"]),
]


def spoilt(path, value):
    x = copy.deepcopy(GOOD)
    at = x
    for k in path[:-1]:
        at = at[k]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(x)


def test_every_failure_is_named_and_goes_to_the_rejects(spark, tmp_path):
    rows = [(0, json.dumps(GOOD)), *((i + 1, spoilt(p, v)) for i, (p, v, _) in enumerate(FAULTS)), (98, "[]"), (99, "no json"), (100, None)]
    want = {0: [], **{i + 1: r for i, (_, _, r) in enumerate(FAULTS)}, **dict.fromkeys((98, 99, 100), ["summary: no JSON object"])}
    add(spark, tmp_path, rows, "id long, record string")
    accepted, rejects = P.screen(stream(spark, tmp_path, "id long, record string"), "record", CONTRACT, f"{tmp_path}/state")
    got = {i: [] for i in want}
    for r in rejects.read().collect():
        got[r["id"]].append(r["reason"])
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert {r["id"] for r in accepted.read().collect()} == {i for i, x in want.items() if not x}

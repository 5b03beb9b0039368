"""The firewall for monitoring summaries: exact keys, types, bounds and nested count maps, every failure named.

A summary is JSON text, read once as VARIANT, so that keys nobody expects and values of the wrong type are seen. Rules
that rest on a broken part don't add reasons of their own: a missing number is one failure, not several.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.functions.columns import once

# What a summary says and how.
KEYS = {
    "": ("schema_version", "producer", "data_classification", "review_status", "publication_eligible", "intended_consumers", "window", "sampling_frame", "coverage", "detections", "limitations"),
    "window": ("start", "end", "complete"),
    "sampling_frame": ("surface", "universal_telegram_coverage", "raw_messages_included", "exact_iocs_included", "source_identifiers_included"),
    "coverage": ("messages_observed", "messages_flagged", "sources_observed", "collection_errors"),
    "detections": ("status", "minimum_messages", "minimum_sources", "tier_counts", "family_counts"),
}
TIERS = ("CLEAN", "WATCH", "LIKELY_SCAM", "CONFIRMED_PATTERN")
STATUSES = ("AVAILABLE_FOR_REVIEW", "INSUFFICIENT_COVERAGE")
SURFACE = "configured_public_or_operator_authorized_telegram"
UTC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$"
FAMILY = r"^[\p{L}\p{N}][\p{L}\p{N} ._:+/\-]{0,127}$"
NO_FAMILY = ("__proto__", "prototype", "constructor")
MOST_SAFE = float(2**53 - 1)


@dataclass(frozen=True)
class Contract:
    """Who may send what to whom."""

    schema_version: str
    producer: str
    consumer: str


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def _whole(v: Column, least: int) -> Column:
    """A number without fraction, from ``least`` on, that a double holds exactly."""
    x = F.when(_type(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    return F.coalesce((x == F.floor(x)) & x.between(float(least), MOST_SAFE), F.lit(False))


def _map(v: Column) -> Column:
    """An object's values by key; null for anything else."""
    return F.when(_type(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def _list(v: Column) -> Column:
    return F.when(_type(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def parts() -> list[str]:
    """The paths that rules look at."""
    return [f"{k}.{x}" if k else x for k, names in KEYS.items() for x in names]


def reasons(record: Column, part: Callable[[str], Column], contract: Contract) -> Column:
    """All that is wrong with the summary ``record``, in the order of the contract; empty if it is accepted. ``part``: what it has at a path, as VARIANT."""
    at = part
    text = lambda path: F.when(_type(at(path)) == "STRING", F.try_variant_get(at(path), "$", "string"))
    number = lambda path, least=0: F.when(_whole(at(path), least), F.try_variant_get(at(path), "$", "double"))
    is_ = lambda path, value: F.coalesce(text(path) == value, F.lit(False))
    false = lambda path: F.coalesce((_type(at(path)) == "BOOLEAN") & ~F.try_variant_get(at(path), "$", "boolean"), F.lit(False))
    checks: list[tuple[Column, str]] = []

    def fails(broken: Column, reason: str) -> None:
        checks.append((F.coalesce(broken, F.lit(False)), reason))

    def exact(name: str) -> Column:
        have = F.map_keys(_map(at(name) if name else record))
        return F.coalesce(F.array_sort(have) == F.array(*map(F.lit, sorted(KEYS[name]))), F.lit(False))

    fails(~exact(""), "summary: keys")
    fails(~is_("schema_version", contract.schema_version), "schema_version: unsupported")
    fails(~is_("producer", contract.producer), "producer: unknown")
    fails(~is_("data_classification", "PRIVATE_ANALYST_REVIEW"), "data_classification: not private")
    fails(~is_("review_status", "HUMAN_REVIEW_REQUIRED"), "review_status: no human review")
    fails(~false("publication_eligible"), "publication_eligible: not false")
    consumers = _list(at("intended_consumers"))
    strings = F.transform(consumers, lambda x: F.when(_type(x) == "STRING", F.try_variant_get(x, "$", "string")))
    fails(~F.coalesce(F.array_contains(F.array_compact(strings), contract.consumer) & F.forall(strings, lambda s: s.isNotNull()), F.lit(False)), "intended_consumers: not for us")
    fails(~exact("window"), "window: keys")
    times = {}
    for end in ("start", "end"):
        said = text(f"window.{end}")
        times[end] = F.when(said.rlike(UTC), F.try_to_timestamp(said))
        fails(~F.coalesce(said.rlike(UTC), F.lit(False)), f"window.{end}: no ISO-8601 UTC timestamp")
        fails(said.rlike(UTC) & times[end].isNull(), f"window.{end}: no real timestamp")
    fails(times["end"] <= times["start"], "window: end doesn't follow start")
    fails(_type(at("window.complete")) != "BOOLEAN", "window.complete: no boolean")
    fails(~exact("sampling_frame"), "sampling_frame: keys")
    fails(~is_("sampling_frame.surface", SURFACE), "sampling_frame.surface: not approved")
    for field in KEYS["sampling_frame"][1:]:
        fails(~false(f"sampling_frame.{field}"), f"sampling_frame.{field}: not false")
    fails(~exact("coverage"), "coverage: keys")
    for field in KEYS["coverage"]:
        fails(number(f"coverage.{field}").isNull(), f"coverage.{field}: no count")
    observed, sources = number("coverage.messages_observed"), number("coverage.sources_observed")
    fails(number("coverage.messages_flagged") > observed, "coverage: more flagged than observed")
    fails(~exact("detections"), "detections: keys")
    status = text("detections.status")
    fails(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "detections.status: unknown")
    least = {f: number(f"detections.minimum_{f}", 1) for f in ("messages", "sources")}
    for f, n in least.items():
        fails(n.isNull(), f"detections.minimum_{f}: no positive count")
    maps = {f: _map(at(f"detections.{f}_counts")) for f in ("tier", "family")}
    for f, m in maps.items():
        path = f"detections.{f}_counts"
        fails(m.isNull(), f"{path}: no object")
        fails(F.size(m) > 100, f"{path}: more than 100 entries")
        named = (lambda k: k.isin(*TIERS)) if f == "tier" else (lambda k: k.rlike(FAMILY) & ~k.isin(*NO_FAMILY))
        fails(~F.forall(F.map_keys(m), named), f"{path}: unknown name")
        fails(~F.forall(F.map_values(m), lambda v: _whole(v, 0)), f"{path}: no count")
    whole = F.transform(F.map_values(maps["tier"]), lambda v: F.when(_whole(v, 0), F.try_variant_get(v, "$", "double")))
    fails(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x) > observed, "detections.tier_counts: more than observed")
    fails((status == STATUSES[1]) & ((F.size(maps["tier"]) > 0) | (F.size(maps["family"]) > 0)), "detections: counts not suppressed")
    fails((status == STATUSES[0]) & ((observed < least["messages"]) | (sources < least["sources"])), "detections: coverage too small")
    limits = F.transform(_list(at("limitations")), lambda x: F.when(_type(x) == "STRING", F.try_variant_get(x, "$", "string")))
    good = F.size(limits).between(1, 20) & F.forall(limits, lambda s: F.coalesce((F.trim(s) != "") & (F.length(s) <= 500), F.lit(False)))
    fails(~F.coalesce(good, F.lit(False)), "limitations: no list of one to 20 texts")
    wrong = F.array_compact(F.array(*(F.when(broken, F.lit(reason)) for broken, reason in checks)))
    return F.when(F.coalesce(_type(record).startswith("OBJECT"), F.lit(False)), wrong).otherwise(F.array(F.lit("summary: no JSON object")))


def judged(df: DataFrame, record: str, contract: Contract) -> DataFrame:
    """``df`` with ``reasons``; batch or stream. A record is parsed once and looked up once a path, not once a rule."""
    parsed = df.select("*", once(F.try_parse_json(record)).alias("__record"))
    places = {path: f"p{i}" for i, path in enumerate(parts())}
    looked = parsed.select("*", once(F.struct(*(F.try_variant_get("__record", f"$.{path}", "variant").alias(p) for path, p in places.items()))).alias("__parts"))
    told = reasons(F.col("__record"), lambda path: F.col(f"__parts.{places[path]}"), contract)
    return looked.withColumn("reasons", told).drop("__record", "__parts")

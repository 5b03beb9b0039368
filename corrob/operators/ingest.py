"""Validated ingest: ordered rules, the first that fails names the reason; rejects keep their line number."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.functions import columns as C

# Vocabularies and synonyms of published records.
DRUGS = ("cocaine", "heroin", "methamphetamine", "cannabis", "ecstasy", "fentanyl", "ketamine", "opium")
PRECURSORS = ("ephedrine", "pseudoephedrine", "acetic_anhydride", "safrole")
ACTOR_TYPES = {"state_forces": "state", "state": "state", "military": "state", "ethnic_armed_group": "ethnic_armed", "ethnic_armed": "ethnic_armed", "militia": "militia", "pdf": "resistance", "resistance": "resistance"}
EVENT_TYPES = {"battle": "battle", "battles": "battle", "territory": "territorial_control", "territorial_control": "territorial_control", "explosion": "explosion", "explosions": "explosion", "violence_against_civilians": "civilian_targeting"}
CONFIDENCE = {"official": "official", "reported": "reported", "estimated": "estimated", "estimate": "estimated"}
SUBSTANCES = [("t40.0-", "opioids_all"), ("t40.4", "synthetic_opioids"), ("cocaine", "cocaine"), ("psychostimulants", "psychostimulants"), ("heroin", "heroin")]


@dataclass(frozen=True)
class Rule:
    """``fails`` is true (not null) for rows to reject."""

    fails: Column
    reason: str


def required(*fields: str) -> Rule:
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    return Rule(missing, "missing required fields")


def member(field: str, vocabulary: Sequence[str], reason: str | None = None) -> Rule:
    return Rule(~F.coalesce(F.col(field).isin(*vocabulary), F.lit(False)), reason or f"unknown {field}")


def non_negative(field: str) -> Rule:
    return Rule(F.coalesce(F.col(field) < 0, F.lit(False)), f"negative {field}")


def within(field: str, low: float, high: float) -> Rule:
    return Rule(~F.coalesce(F.col(field).between(low, high), F.lit(False)), f"{field} out of range")


def reasoned(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``reason``: the first rule that a row fails, or null."""
    reason = F.lit(None).cast("string")
    for r in reversed(rules):
        reason = F.when(r.fails, F.lit(r.reason)).otherwise(reason)
    return df.withColumn("reason", reason)


class Checked(tuple):
    """(valid rows, rejects); ``marked`` has both in one table, with ``reason``."""

    def __new__(cls, valid: DataFrame, rejects: DataFrame, marked: DataFrame) -> Checked:
        out = super().__new__(cls, (valid, rejects))
        out.marked = marked
        return out


def place(df: DataFrame) -> list[str]:
    """The columns that say where a row comes from: its line, and its file where the reader told it."""
    return [c for c in ("file", "line") if c in df.columns]


def validate(df: DataFrame, rules: Sequence[Rule], line: str = "line") -> Checked:
    """(valid rows, rejects as file (if there is one), line, reason and message)."""
    # Typed fields are worked out once: rules name them many times, and filters on the reason would repeat them.
    typed = df.select(C.once(F.struct(*df.columns)).alias("__row")).select("__row.*")
    marked = reasoned(typed, rules)
    at = [c for c in place(df) if c != line] + [line]
    rejects = marked.where("reason is not null").select(*at, "reason", F.format_string("Row %s: %s", F.col(line).cast("string"), "reason").alias("message"))
    return Checked(marked.where("reason is null").drop("reason"), rejects, marked)


def flag_unknown(df: DataFrame, field: str, known: DataFrame, key: str) -> DataFrame:
    """Rows stay; ``unknown_<field>`` marks ids that ``known`` doesn't have."""
    ids = known.select(F.col(key).alias("__id")).distinct().withColumn("__known", F.lit(True))
    return df.join(ids, F.col(field) == F.col("__id"), "left").withColumn(f"unknown_{field}", F.col("__known").isNull()).drop("__id", "__known")


def _s(name: str) -> Column:
    return C.coerce_string(F.col(name))


def _n(name: str) -> Column:
    return C.coerce_number(F.col(name))


def prices(raw: DataFrame, drugs: Sequence[str] = DRUGS):
    """drug, country, iso3, region, year, price, purity (clamped to 0-100, null if unreadable)."""
    typed = raw.select(*place(raw), C.slug(_s("drug")).alias("drug"), _s("country").alias("country"), F.upper(_s("iso3")).alias("iso3"), _s("region").alias("region"), C.coerce_int(F.col("year")).alias("year"), _n("price").alias("price"), C.clamp_pct(F.col("purity")).alias("purity"))
    return validate(typed, [Rule(F.col("drug").isNull() | F.col("country").isNull() | F.col("year").isNull() | F.col("price").isNull(), "missing required fields"), member("drug", drugs), non_negative("price")])


def precursor_prices(raw: DataFrame, precursors: Sequence[str] = PRECURSORS):
    typed = raw.select(*place(raw), C.slug(_s("precursor")).alias("precursor"), _s("country").alias("country"), C.coerce_int(F.col("year")).alias("year"), _n("price").alias("price"))
    return validate(typed, [required("precursor", "country", "year", "price"), member("precursor", precursors), non_negative("price")])


def flows(raw: DataFrame, precursors: Sequence[str] = PRECURSORS):
    typed = raw.select(*place(raw), C.slug(_s("precursor")).alias("precursor"), _s("origin").alias("origin"), _s("transit").alias("transit"), _s("destination").alias("destination"), C.coerce_int(F.col("year")).alias("year"), _n("quantity").alias("quantity"))
    return validate(typed, [required("precursor", "origin", "destination", "year", "quantity"), member("precursor", precursors), non_negative("quantity")])


def nodes(raw: DataFrame):
    typed = raw.select(*place(raw), C.slug(F.coalesce(_s("id"), _s("label"))).alias("id"), _s("label").alias("label"), _n("lat").alias("lat"), _n("lng").alias("lng"))
    return validate(typed, [required("id", "label", "lat", "lng"), within("lat", -90, 90), within("lng", -180, 180)])


def region_stats(raw: DataFrame, known: DataFrame | None = None):
    typed = raw.select(*place(raw), C.slug(_s("region")).alias("region"), C.coerce_int(F.col("year")).alias("year"), _n("ha").alias("ha"), C.clamp_pct(F.col("index")).alias("index"))
    valid, rejects = validate(typed, [required("region", "year", "ha"), non_negative("ha")])
    return (flag_unknown(valid, "region", known, "region") if known is not None else valid), rejects


def regional_flows(raw: DataFrame, synonyms: dict[str, str], known: DataFrame | None = None):
    typed = raw.select(*place(raw), C.slug(_s("from")).alias("from"), C.slug(_s("to")).alias("to"), C.coerce_int(F.col("year")).alias("year"), _n("quantity").alias("quantity"), C.synonym(_s("product"), synonyms).alias("product"), _s("source_name").alias("source_name"))
    valid, rejects = validate(typed, [required("from", "to", "year", "quantity"), Rule(F.col("product").isNull(), "unknown product"), non_negative("quantity")])
    return (flag_unknown(flag_unknown(valid, "from", known, "region"), "to", known, "region") if known is not None else valid), rejects


def events(raw: DataFrame):
    """Unknown actor and event types take defaults instead of being rejected; intensity is clamped."""
    typed = raw.select(*place(raw), C.slug(_s("region")).alias("region"), C.coerce_int(F.col("year")).alias("year"), _s("actor").alias("actor"), C.synonym(_s("actor_type"), ACTOR_TYPES, "unknown").alias("actor_type"), C.synonym(_s("event_type"), EVENT_TYPES, "other").alias("event_type"), C.clamp_pct(F.col("intensity")).alias("intensity"))
    return validate(typed, [required("region", "year", "actor", "intensity")])


def inflows(raw: DataFrame, precursors: Sequence[str] = PRECURSORS):
    typed = raw.select(*place(raw), _s("origin").alias("origin"), C.slug(_s("to")).alias("to"), C.coerce_int(F.col("year")).alias("year"), C.slug(_s("precursor")).alias("precursor"), _n("quantity").alias("quantity"), C.synonym(_s("confidence"), CONFIDENCE, "reported").alias("confidence"))
    return validate(typed, [required("origin", "to", "year", "precursor", "quantity"), member("precursor", precursors), non_negative("quantity")])


def substance(label: Column) -> Column:
    """Canonical substance by the first part that the label contains; the order matters."""
    out = F.lit(None).cast("string")
    for part, name in reversed(SUBSTANCES):
        out = F.when(F.contains(F.lower(label), F.lit(part)), F.lit(name)).otherwise(out)
    return out


def mortality(raw: DataFrame):
    """A suppressed cell is rejected, never zero; the window's month defaults to 12, others are partial years."""
    month = F.coalesce(C.coerce_month(F.col("month")), F.lit(12).cast("long"))
    typed = raw.select(*place(raw), _s("jurisdiction").alias("jurisdiction"), C.coerce_int(F.col("year")).alias("year"), month.alias("month"), substance(F.col("substance")).alias("substance"), _n("deaths").alias("deaths"), _n("predicted").alias("predicted"))
    typed = typed.withColumns({"partial": F.col("month") != 12, "predicted": F.when(~F.col("predicted").eqNullSafe(F.col("deaths")), F.col("predicted"))})
    return validate(typed, [required("jurisdiction", "year"), Rule(F.col("substance").isNull(), "unknown substance"), Rule(F.col("deaths").isNull(), "suppressed or missing deaths"), non_negative("deaths")])


def wastewater(raw: DataFrame, drugs: Sequence[str] = DRUGS):
    typed = raw.select(*place(raw), _s("site").alias("site"), _s("country").alias("country"), C.coerce_int(F.col("year")).alias("year"), C.slug(_s("drug")).alias("drug"), _n("load").alias("load"))
    return validate(typed, [required("site", "country", "year", "load"), member("drug", drugs), non_negative("load")])


def designations(raw: DataFrame):
    """Lists are split; no program rejects a row, an unknown kind counts as organization."""
    kind = C.slug(_s("kind"))
    known = F.coalesce(kind.isin("individual", "vessel", "aircraft", "organization"), F.lit(False))
    typed = raw.select(*place(raw), _s("name").alias("name"), F.when(known, kind).otherwise("organization").alias("kind"), (~known).alias("kind_defaulted"), C.split_list(F.col("programs")).alias("programs"), C.split_list(F.col("countries")).alias("countries"))
    return validate(typed, [required("name"), Rule(F.size("programs") == 0, "no program")])


def december_or_latest(df: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """Windows that end in December, and the single latest one of all."""
    last = df.agg(F.max(F.struct(F.col(year).alias("y"), F.col(month).alias("m"))).alias("__last"))
    out = df.join(F.broadcast(last), F.lit(True))  # one row
    return out.where((F.col(month) == 12) | ((F.col(year) == F.col("__last.y")) & (F.col(month) == F.col("__last.m")))).drop("__last")


def resolve_price(typical: Column, low: Column, high: Column) -> Column:
    return F.coalesce(typical, (low + high) / 2)

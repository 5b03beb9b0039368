"""Quality gates: expectations that name every failure, registries, claim support, histories, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob.functions.columns import half_up


def expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, failures, passed: all rules in one pass; a condition that is null fails."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("failures")) for i, n in enumerate(rules))))
    return one.select(rows.alias("r")).select("r.rule", "r.failures", (F.col("r.failures") == 0).alias("passed"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def registry_gate(df: DataFrame, key: str, rules: dict[str, Column], must_have: DataFrame) -> DataFrame:
    """Rules, unique ids, and ids that must be there, as expectation rows."""
    dup = duplicates(df, key).agg(F.count(F.lit(1)).alias("failures")).select(F.lit("unique ids").alias("rule"), "failures")
    missing = must_have.select(key).distinct().join(df.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("failures")).select(F.lit("required ids present").alias("rule"), "failures")
    more = dup.unionByName(missing).withColumn("passed", F.col("failures") == 0)
    return expectations(df, rules).unionByName(more)


# What fields of an audited flow imply about one another.
def flow_rules() -> dict[str, Column]:
    rel, kind, fit, group = (F.col(c) for c in ("quantity_relation", "record_kind", "eligibility", "aggregation_group"))
    implies = lambda a, b: ~a | b
    return {
        "non-exact is ineligible_non_exact": implies(rel != "exact", fit == "ineligible_non_exact"),
        "exact isn't ineligible_non_exact": implies(rel == "exact", fit != "ineligible_non_exact"),
        "eligible is exact, not derived, grouped": implies(fit == "eligible", (rel == "exact") & (kind != "derived_subtotal") & group.isNotNull()),
        "derived is ineligible_derived": implies(kind == "derived_subtotal", fit == "ineligible_derived"),
        "ineligible_derived is derived": implies(fit == "ineligible_derived", kind == "derived_subtotal"),
        "derived has no group": implies(kind == "derived_subtotal", group.isNull()),
        "incompatible has no group": implies(fit == "ineligible_incompatible_basis", group.isNull()),
        "quantity is known and not negative": F.col("qty") >= 0,
    }


def claim_support(sentences: DataFrame, sources: DataFrame, least_groups: Column) -> DataFrame:
    """Active sources and independent active groups per sentence against the minimum; other roles count nothing.

    ``sentences``: id, citations (array), kind. ``sources``: source_id, role, available, group.
    """
    cited = sentences.select("id", F.explode(F.array_distinct("citations")).alias("source_id")).join(sources, "source_id")
    active = (F.col("role") == "active") & F.col("available")
    g = cited.groupBy("id").agg(F.countDistinct(F.when(active, F.col("source_id"))).alias("active"), F.countDistinct(F.when(active, F.col("group"))).alias("groups"))
    out = sentences.select("id", "kind").join(g, "id", "left").fillna(0, ["active", "groups"])
    return out.withColumn("supported", F.col("groups") >= least_groups)


def citation_coverage(df: DataFrame, citations: str) -> DataFrame:
    n, c = F.count(F.lit(1)), F.count_if(F.size(citations) > 0)
    return df.agg(c.alias("cited"), n.alias("total"), F.when(n > 0, half_up(c / n * 100, 1)).alias("pct"))


def rule_scan(df: DataFrame, key: str | list[str], columns: list[str], rules: list[tuple[str, str]]) -> DataFrame:
    """key, field, rule: every rule that matches any text column. Rules are few; texts are read once."""
    keys = [key] if isinstance(key, str) else key
    hits = [F.when(F.col(c).rlike(p), F.struct(F.lit(c).alias("field"), F.lit(n).alias("rule"))) for c in columns for p, n in rules]
    return df.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(*keys, "h.field", "h.rule")


def forbidden_columns(df: DataFrame, denied: set[str]) -> list[str]:
    """Paths of the schema whose last name is denied, nested structs and arrays included."""

    def walk(t, path):
        for f in getattr(t, "fields", []):
            if f.name.lower() in denied:
                yield ".".join([*path, f.name])
            inner = f.dataType
            while hasattr(inner, "elementType"):
                inner = inner.elementType
            yield from walk(inner, [*path, f.name])

    return list(walk(df.schema, []))


def history_gate(df: DataFrame, chain: str, order: str, kind: str, first_kind: str, digest: str, time: str) -> DataFrame:
    """Per chain: first event of the right type, all hashes different, times never going back."""
    w = Window.partitionBy(chain).orderBy(order)
    m = df.withColumns({"__rn": F.row_number().over(w), "__back": F.col(time) < F.lag(time).over(w)})
    g = m.groupBy(chain).agg(F.max(F.when(F.col("__rn") == 1, F.col(kind))).alias("first"), F.count(F.lit(1)).alias("n"), F.countDistinct(digest).alias("hashes"), F.count_if("__back").alias("back"))
    return g.select(chain, (F.col("first") == first_kind).alias("starts_right"), (F.col("n") == F.col("hashes")).alias("unique_hashes"), (F.col("back") == 0).alias("monotone"))


def append_revision(history: DataFrame, candidates: DataFrame, chain: str, digest: str, time: str, tie: str | None = None) -> DataFrame:
    """Per candidate: ``no-op`` (the current hash), ``replay`` (an earlier one), ``backwards``, or ``append``.

    ``tie`` tells which of the records of one time is the current one.
    """
    last = history.groupBy(chain).agg(F.max(time).alias("__last"), F.max_by(digest, F.struct(time, tie) if tie else F.col(time)).alias("__current"))
    seen = history.select(chain, digest).distinct().withColumn("__seen", F.lit(True))
    c = candidates.join(last, chain, "left").join(seen, [chain, digest], "left")
    what = F.when(F.col(digest) == F.col("__current"), "no-op").when(F.col("__seen"), "replay").when(F.col(time) <= F.col("__last"), "backwards").otherwise("append")
    return c.select(chain, digest, time, what.alias("outcome"))


def recompute_check(stored: DataFrame, recomputed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose stored value isn't the recomputed one, null-safe; keys of one side only count."""
    j = stored.withColumnRenamed(value, "stored").join(recomputed.withColumnRenamed(value, "recomputed"), keys, "full")
    return j.where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def receipt(gates: dict[str, DataFrame]) -> DataFrame:
    """One row over expectation tables: assertions, failures, names of what failed, passed."""
    all_ = None
    for name, g in gates.items():
        x = g.select(F.concat(F.lit(f"{name}: "), "rule").alias("rule"), "passed")
        all_ = x if all_ is None else all_.unionByName(x)
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("rule"))))  # a row per rule
    return all_.agg(F.count(F.lit(1)).alias("assertions"), F.count_if(~F.col("passed")).alias("failures"), F.array_join(failed, "; ").alias("failed")).withColumn("passed", F.col("failures") == 0)

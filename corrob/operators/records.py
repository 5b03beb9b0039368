"""Nested records in JSON: every key and string at any depth with its path, canonical form, content hashes.

Records are parsed once to VARIANT and walked level by level: a level's objects and arrays are exploded to the rows of
the next, which are written before the one after it, so records of any shape and depth take one job a level. Text that
is no JSON has no nodes and no canonical form.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.sources.shared import stash

# Names of fields that a published record must not have, without case and punctuation.
PERSONAL_KEYS = (
    "address", "addresses", "alias", "aliases", "coordinates", "dateofbirth", "dob", "email", "emailaddress", "entitynumber", "fullname", "identitynumber",
    "name", "passport", "phone", "phonenumber", "subject", "subjects", "telephone", "wallet", "walletaddress",
)


def nodes(df: DataFrame, key: str, record: str) -> DataFrame:
    """key, path, name, kind, text: every value inside the records, at any depth; not the records themselves.

    ``path`` joins keys and, for elements of arrays, places from 0 by dots; ``name`` is the last key, null for elements.
    ``kind`` is object, array, string, number, boolean, null or other; ``text`` is the value of a scalar.
    """
    type_ = F.schema_of_variant("v")
    kind = F.when(type_.startswith("OBJECT"), "object").when(type_.startswith("ARRAY"), "array").when(type_ == "STRING", "string").when(type_ == "BOOLEAN", "boolean")
    kind = kind.when(type_ == "VOID", "null").when(type_.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("other")
    text = F.when(~F.col("kind").isin("object", "array", "null"), F.col("v").cast("string")).alias("text")
    spark, out = df.sparkSession, None
    at = df.select(F.col(key).alias("id"), F.lit(None).cast("string").alias("path"), F.try_parse_json(record).alias("v")).where("v is not null")
    while True:
        inner = at.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("inner")))
        step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        level = inner.select("id", F.concat_ws(".", "path", step).alias("path"), F.col("key").alias("name"), F.col("inner").alias("v")).withColumn("kind", kind)
        level = stash(level, "nodes")
        found = level.select(F.col("id").alias(key), "path", "name", "kind", text)
        out = found if out is None else out.unionByName(found)
        at = level.where("kind in ('object', 'array')").select("id", "path", "v")
        if at.isEmpty():
            return out


def plain_name(name: Column) -> Column:
    """A key without case and punctuation."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def forbidden_keys(found: DataFrame, denied: tuple[str, ...] = PERSONAL_KEYS) -> DataFrame:
    """The nodes (key and path) whose name is denied, whatever its case and punctuation."""
    return found.where(plain_name(F.col("name")).isin(*denied)).drop("name", "kind", "text")


def strings(found: DataFrame) -> DataFrame:
    """The strings among the nodes: key, path, text."""
    return found.where("kind = 'string'").drop("name", "kind")


def script_number(x: float) -> str:
    """A number as scripts write it: shortest digits, an exponent below 1e-6 and from 1e21 on."""
    if x == 0:
        return "0"
    if 1e-4 <= abs(x) < 2**53:  # most numbers: as Python writes them
        return str(int(x)) if x == int(x) else repr(x)
    sign, x = ("-", -x) if x < 0 else ("", x)
    digits, _, exponent = f"{x!r}".partition("e")
    whole, _, part = digits.partition(".")
    point = len(whole) + int(exponent or 0)
    digits = whole + ("" if part == "0" else part)
    point -= len(digits) - len(digits.lstrip("0"))
    digits = digits.strip("0")
    n = len(digits)
    if -6 < point <= 21:
        if point >= n:
            return sign + digits + "0" * (point - n)
        return sign + (f"{digits[:point]}.{digits[point:]}" if point > 0 else f"0.{'0' * -point}{digits}")
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{point - 1:+d}"


def script_order(name: str):
    """Keys as scripts list them once sorted: whole numbers below 2^32 − 1 first, by value; then UTF-16 code units."""
    if re.fullmatch("0|[1-9][0-9]{0,9}", name) and int(name) < 2**32 - 1:
        return (0, int(name), b"")
    return (1, 0, name.encode("utf-16-be", "surrogatepass"))


def script_text(text: str) -> str:
    """A string in quotes; what is no character by itself is escaped."""
    quoted = json.encoder.encode_basestring(text)
    return quoted if quoted.isascii() else re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", quoted)


@functools.lru_cache(maxsize=10_000)
def script_key(name: str):
    """(place, written form) of a key: records share their keys."""
    return script_order(name), script_text(name)


def canonical(record: str | None, without: str | None = None) -> str | None:
    """A record as JSON with the keys of each object sorted and nothing else changed; None where it is no JSON.

    Numbers are read as doubles. Of a repeated key the last value counts. ``without`` leaves out one key of the record itself.
    """

    def no_number(name: str):
        raise ValueError(name)

    def written(x) -> str:
        if isinstance(x, str):
            return script_text(x)
        if isinstance(x, float):
            return script_number(x) if math.isfinite(x) else "null"
        if isinstance(x, dict):
            keys = sorted((*script_key(k), k) for k in x)
            return "{" + ",".join(f"{said}:{written(x[k])}" for _, said, k in keys) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(written, x)) + "]"
        return "null" if x is None else "true" if x else "false"

    if record is None:
        return None
    try:
        value = json.loads(record, parse_int=float, parse_constant=no_number)
        if without is not None and isinstance(value, dict):
            value.pop(without, None)
        return written(value)
    except (ValueError, RecursionError):
        return None


def canonical_json(record: Column, without: str | None = None) -> Column:
    """``canonical`` of a column; a batch of texts at a time."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([canonical(t, without) for t in texts], dtype=object)

    return run(record)


def row_json(*columns: str) -> Column:
    """Columns of a row as a JSON record; null is a null in it, unlike a column that isn't there."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def content_hash(record: Column, field: str = "contentHash") -> Column:
    """SHA-256 of a record's canonical form without its own hash."""
    return F.sha2(canonical_json(record, field), 256)


def verify_hashes(df: DataFrame, record: str, field: str = "contentHash") -> DataFrame:
    """``df`` with ``verified``: whether a record carries, under ``field``, the hash of what else it says. No JSON, no hash: false."""
    said = F.get_json_object(record, f"$.{field}")
    return df.withColumn("verified", F.coalesce(said == content_hash(F.col(record), field), F.lit(False)))

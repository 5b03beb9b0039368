"""Column expressions: numbers as ingest reads them, rounding, vocabularies, text and hashes. No Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Tokens that mean no value, and month names.
NULL_TOKENS = ("", "-", "n/a", "na", "null")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x · 10^digits + ½) / 10^digits: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def half_up_int(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def once(value: Column) -> Column:
    """``value`` worked out once a row, however often later columns and filters name it. A row stays one row."""
    return F.explode(F.array(value))


def coerce_string(x: Column) -> Column:
    return F.when(~F.lower(F.trim(x)).isin(*NULL_TOKENS), F.trim(x))


def coerce_number(x: Column) -> Column:
    """A finite decimal number, else null; no suffixes, separators, hexadecimal, NaN or infinities."""
    s = coerce_string(x)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def coerce_int(x: Column) -> Column:
    return half_up_int(coerce_number(x))


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clamp_pct(x: Column) -> Column:
    return clamp(coerce_number(F.replace(x, F.lit("%"), F.lit(""))), 0.0, 100.0)


def coerce_month(x: Column) -> Column:
    """1 to 12 from a number, a name or its first three letters."""
    s = F.lower(coerce_string(x))
    number = coerce_int(s)
    out = F.when((number >= 1) & (number <= 12), number)
    for i, name in enumerate(MONTHS, 1):
        out = F.when(s.isin(name, name[:3]), F.lit(i).cast("long")).otherwise(out)
    return out


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "_"), F.lit("_"))


def parse_numeric(x: Column) -> Column:
    return coerce_number(F.regexp_replace(x, r"[,$%\s]", ""))


def parse_year(x: Column) -> Column:
    return F.regexp_extract(F.trim(x), r"^(\d{4})", 1).try_cast("int")


def split_list(x: Column) -> Column:
    """Parts at ``] [``, ``;`` or ``|``, without brackets, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\]\s*\[|;|\|"), lambda p: F.trim(F.regexp_replace(p, r"[\[\]]", ""))), lambda p: p != "")


def first_match(x: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The value of the first rule (regular expression, value) that matches; patterns carry their own flags."""
    out = F.lit(None).cast("string") if default is None else default
    for pattern, value in reversed(rules):
        out = F.when(F.coalesce(x, F.lit("")).rlike(pattern), F.lit(value)).otherwise(out)
    return out


def synonym(x: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The canonical term for ``x`` in any case and punctuation, else ``default``."""
    lookup = F.create_map(*(F.lit(y) for kv in table.items() for y in kv))
    return F.coalesce(F.try_element_at(lookup, slug(x)), F.lit(default).cast("string"))


def normalized_header(x: Column) -> Column:
    s = F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[%_]", " "), r"\s+", " "))


def route_legs(*stops: Column) -> Column:
    """Consecutive pairs of the non-null stops, as an array of structs."""
    on = F.array_compact(F.array(*stops))
    pairs = F.transform(on, lambda x, i: F.struct(x.alias("a"), F.get(on, i + 1).alias("b")))
    return F.filter(pairs, lambda p: p["b"].isNotNull())


def affordability_days(price: Column, gdp: Column) -> Column:
    return F.when(gdp > 0, price / (gdp / 365))


def purity_adjusted(price: Column, purity: Column) -> Column:
    return F.when((purity > 0) & (purity <= 100), price / (purity / 100))


def log_share(x: Column, most: Column) -> Column:
    return F.when((x > 0) & (most > 0), F.least(F.lit(1.0), F.log10(x + 1) / F.log10(most + 1))).otherwise(0.0)


def sqrt_ramp(x: Column, most: Column) -> Column:
    return F.when((x > 0) & (most > 0), F.least(F.lit(1.0), F.sqrt(x / most))).otherwise(0.0)


def rate_per_100k(n: Column, population: Column) -> Column:
    return F.when(population > 0, half_up(n * 100_000 / population, 1))


def round_sig(x: Column, digits: int = 6) -> Column:
    """Rounded to significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), digits - F.ceil(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x * scale + 0.5) / scale)


def humanize_mass(kg: Column) -> Column:
    return F.when(kg >= 1000, F.format_string("%.1f t", half_up(kg / 1000, 1))).when(kg >= 1, F.format_string("%.0f kg", half_up(kg))).otherwise(F.format_string("%.0f g", half_up(kg * 1000)))


def qualifier(relation: Column) -> Column:
    return F.when(relation == "approximate", "≈").when(relation == "below", "<").when(relation == "above", ">").otherwise("")


def excel_serial_year(serial: Column) -> Column:
    return F.year(F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int")))


def host_of(url: Column) -> Column:
    """Lower-case host without port; null where the URL is invalid."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by U+001F, null as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


#: White space as scripts of pages mean it: ASCII, Unicode separators and the byte-order mark.
BLANKS = r"[\s\x0B\p{Z}\x{FEFF}]+"


def up_to_last(s: Column, end: str) -> tuple[Column, Column]:
    """``s`` parted after the last match of pattern ``end``. What begins in the second part can't be closed, so nobody looks for it there."""
    head = F.regexp_extract(s, f"(?is)^.*{end}", 0)
    return head, F.substring(s, F.length(head) + 1, F.lit(1 << 30))


def without_elements(s: Column, tag: str) -> Column:
    """``s`` with a blank for each element ``tag`` that is closed, in linear time."""
    head, rest = up_to_last(s, f"</{tag}>")
    return F.concat(F.regexp_replace(head, rf"(?is)<{tag}.*?</{tag}>", " "), rest)


def normalize_body(x: Column, most: int | None = None) -> Column:
    """Text without scripts and styles, runs of three digits and more masked, white space collapsed; its first ``most`` characters, or all."""
    s = F.coalesce(x, F.lit(""))
    for tag in ("script", "style"):
        s = without_elements(s, tag)
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[0-9]{3,}", "#"), BLANKS, " "))
    return s if most is None else F.substring(s, 1, most)


def strip_tags(x: Column) -> Column:
    """Text without tags; four entities decoded, in this order. What opens after the last ``>`` is text."""
    head, rest = up_to_last(x, ">")
    s = F.concat(F.regexp_replace(head, r"<[^>]+>", " "), rest)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, BLANKS, " "))


def items_pattern(tag: str, klass: str | None = None) -> str:
    """Elements ``tag``, their content as group 1; with ``klass``, those whose quoted class attribute has that word."""
    has = rf"""(?=[^>]*\bclass=["'][^"']*\b{re.escape(klass)}\b[^"']*["'])""" if klass else ""
    return rf"(?is)<{re.escape(tag)}\b{has}[^>]*>(.*?)</{re.escape(tag)}>"


def extract_items(html: Column, tag: str, klass: str | None = None) -> Column:
    """Stripped texts of all elements ``tag``, with a class if one is given, in order; empty ones dropped."""
    head, _ = up_to_last(F.coalesce(html, F.lit("")), f"</{re.escape(tag)}>")
    found = F.regexp_extract_all(head, F.lit(items_pattern(tag, klass)), F.lit(1))
    return F.filter(F.transform(found, strip_tags), lambda t: t != "")


def any_phrase(name: Column, aliases: Column, pattern: str) -> tuple[Column, Column]:
    """(matched, field): whether the name or else an alias has the phrase."""
    alias = F.exists(aliases, lambda a: a.rlike(pattern))
    return name.rlike(pattern) | alias, F.when(name.rlike(pattern), "name").when(alias, "alias")

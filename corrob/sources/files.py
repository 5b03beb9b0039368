"""Readers and writers: aliased CSV, headerless dialects, sharded folders, dictionaries, wide years, exports, bundles."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrob.functions.columns import coerce_number, coerce_string, half_up, once
from corrob.operators.ingest import Checked
from corrob.sources.shared import stash


def normalize_header(header: str) -> str:
    """Lower case, words of camelCase split, ``%`` and ``_`` as spaces; file headers only, never data."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", header or "")
    return re.sub(r"\s+", " ", re.sub(r"[%_]", " ", s.lower())).strip()


def header_plan(headers: list[str], aliases: dict[str, list[str]], fallbacks: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """(field → header, ambiguous headers): the first field that knows a header takes it, its last header counts."""
    plan, ambiguous = {}, []
    for h in headers:
        fits = [f for f, names in aliases.items() if normalize_header(h) in map(normalize_header, names)]
        if fits:
            plan[fits[0]] = h
        if len(fits) > 1:
            ambiguous.append(h)
    for field, other in (fallbacks or {}).items():
        if field not in plan and other in plan:
            plan[field] = plan[other]
    return plan, ambiguous


#: White space that scripts trim: ASCII, the no-break space and the byte-order mark.
_TRIMMED = " \t\n\x0b\f\r\u00a0\ufeff"
_CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"}


def text_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines as file, block, at, value; blocks as file, block, first, before, head) of text files, in folders too.

    Lines are trimmed, blank ones left out. A file is read in blocks by many tasks; ``before`` counts the lines of the
    blocks before, ``first`` is the place of a block's first line and ``head`` that line. So a line's number in its file
    is before + at − first + 1, and all numbers and headers come from one pass that keeps a row a block.
    """
    trimmed = F.btrim("value", F.lit(_TRIMMED))
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), trimmed.alias("value"))
    lines = raw.where("value <> ''").withColumn("at", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.min_by("value", "at").alias("head"))
    return lines, stash(blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "blocks")


def read_aliased_csv(
    spark: SparkSession, path: str, aliases: dict[str, list[str]], required: list[str], fallbacks: dict[str, str] | None = None, most_layouts: int = 1000, most_broadcast: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """(records, warnings) of one or many CSV files, each with its own header.

    Records have ``file``, ``line`` (in the file, blank lines not counted, the header being 1) and the canonical fields as strings; null where a file has
    no column for one. Warnings have ``file`` and ``message``: ambiguous headers, and missing required columns, for which
    none of the file's rows are read. Headers may differ in order, names and number of columns; at most ``most_layouts``
    different ones are planned, once each, and all files are parsed in one scan. Plans (a row a block of a file) are broadcast up to ``most_broadcast`` rows.
    """
    lines, blocks = text_blocks(spark, path)
    heads = [r["head"] for r in blocks.where("before = 0").select("head").distinct().limit(most_layouts + 1).collect()]
    if len(heads) > most_layouts:
        raise ValueError(f"more than {most_layouts} different headers under {path}")
    planned, width = [], 1
    for head in heads:
        names = next(csv.reader([head], skipinitialspace=True, strict=False))
        names = [n.strip(_TRIMMED) for n in names]
        plan, ambiguous = header_plan(names, aliases, fallbacks)
        last = {n: i for i, n in enumerate(names)}
        lacking = [f for f in required if f not in plan]
        said = [f"ambiguous header: {h}" for h in ambiguous] + ["missing columns: " + ", ".join(lacking)] * bool(lacking)
        planned.append((head, [last[plan[f]] if f in plan else -1 for f in aliases], not lacking, said))
        width = max(width, len(names))
    plans = spark.createDataFrame(planned, "head string, places array<int>, usable boolean, said array<string>")
    files = blocks.where("before = 0").select("file", "head").join(F.broadcast(plans), "head")
    warnings = files.select("file", F.explode("said").alias("message"))
    known = stash(blocks.select("file", "block", "first", "before").join(files.where("usable").select("file", "places"), "file"), "layouts")
    rows = lines.join(F.broadcast(known) if known.count() <= most_broadcast else known, ["file", "block"])
    rows = rows.withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1).where("line > 1")
    parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), _CSV)
    # A line is parsed once, and its fields are put in order once, however many columns and filters follow.
    fields = rows.select("file", "line", "places", once(parsed).alias("c")).select("file", "line", "places", once(F.array(*(F.col(f"c.c{i}") for i in range(width)))).alias("fields"))
    field = lambda i: F.get("fields", F.when(F.get("places", F.lit(i)) >= 0, F.get("places", F.lit(i))))
    return fields.select("file", "line", *(field(i).alias(f) for i, f in enumerate(aliases))), warnings


def read_sharded_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All shards of a folder in one scan, a partition or more per shard."""
    return spark.read.csv(f"{folder}/*", header=True, schema=schema, quote='"', escape='"')


def read_headerless(spark: SparkSession, path: str, schema: str, null_token: str = "-0-") -> DataFrame:
    """Files without a header; the token and blank strings are null."""
    raw = spark.read.csv(path, schema=schema, quote='"', escape='"', nullValue=null_token, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select(*(F.when(F.trim(c) != "", F.when(F.trim(c) != null_token, F.trim(c))).alias(c) if t == "string" else F.col(c) for c, t in raw.dtypes))


def encode_dictionary(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with codes, dictionary): codes number the values by first appearance in ``order``, from 0.

    The dictionary is parted by range; parts are counted, and each numbers its own values on from those before it.
    """
    first = df.groupBy(key).agg(F.min(order).alias("__first"))
    parted = stash(first.repartitionByRange("__first", key).withColumn("__part", F.spark_partition_id()), "dictionary")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__first", key)) - 1
    numbered = parted.withColumn("__at", inside).join(F.broadcast(starts), "__part")  # a row per partition
    codes = numbered.select(key, (F.col("__start") + F.col("__at")).cast("int").alias("code"))
    return df.join(codes, key).drop(key), codes


def decode_dictionary(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Integer codes to values; each dimension has ``code`` and the column to bring in."""
    for column, dim in dims.items():
        df = df.join(dim.withColumnRenamed("code", column), column, "left").drop(column)
    return df


def export_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: arrays joined by ``; ``, fields quoted where needed, quotes doubled, null as empty."""
    flat = df.select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    flat.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def unpivot_years(wide: DataFrame, ids: list[str], years: list[str], value: str = "value") -> DataFrame:
    """Year columns to rows; positive numbers stay, to two decimals."""
    long = wide.unpivot(ids, years, "year", "__v").withColumn(value, half_up(coerce_number(F.col("__v").cast("string")), 2))
    return long.where(F.col(value) > 0).select(*ids, F.regexp_extract("year", r"(\d{4})", 1).cast("int").alias("year"), value)


def take_until_marker(df: DataFrame, sheet: str, order: str, start: Column, stop: Column) -> DataFrame:
    """Rows after the start row of each sheet, up to its first stop row after that."""
    so_far = Window.partitionBy(sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__on", F.max(start.cast("int")).over(so_far))
    marked = marked.withColumn("__off", F.max((stop & (F.col("__on") == 1) & ~start).cast("int")).over(so_far))
    return marked.where((F.col("__on") == 1) & (F.col("__off") == 0) & ~start).drop("__on", "__off")


def load_bundle(sets: dict[str, Checked]) -> DataFrame:
    """dataset, loaded, rejected: one row per data set, whatever subset was given; each is read once."""
    ok = F.col("reason").isNull()
    counted = lambda name, checked: checked.marked.agg(F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("rejected")).select(F.lit(name).alias("dataset"), "loaded", "rejected")
    rows = [counted(name, checked) for name, checked in sorted(sets.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@dataclass(frozen=True)
class Feed:
    """A data set's files and how they are read: the parser takes the records and gives (valid rows, rejects).

    ``knows``: data sets whose ids the parser takes as well, as a table with ``region``.
    """

    path: str
    aliases: dict[str, list[str]]
    required: list[str]
    parser: Callable[..., tuple[DataFrame, DataFrame]]
    fallbacks: dict[str, str] | None = None
    knows: tuple[str, ...] = ()


def load_feeds(spark: SparkSession, feeds: dict[str, Feed]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by data set, report) of whatever feeds are given; one that can't be read is an error of its own.

    The report has ``dataset, kind, n, file, line, message``: a ``loaded`` row with the number of rows for each data set
    that could be read, a ``warning`` for each header and row that wasn't taken, an ``error`` for each that couldn't be
    read. Data sets whose ids others ask for are read first, whatever the order. Each is parsed once and written.
    """
    tables: dict[str, DataFrame] = {}
    schema = "dataset string, kind string, n long, file string, line long, message string"
    report = spark.createDataFrame([], schema)
    row = lambda name, kind, n, file, line, message: [F.lit(name).alias("dataset"), F.lit(kind).alias("kind"), n.cast("long").alias("n"), file.alias("file"), line.cast("long").alias("line"), message.alias("message")]
    none = F.lit(None).cast("string")
    for name in sorted(feeds, key=lambda k: bool(feeds[k].knows)):
        feed = feeds[name]
        try:
            records, headers = read_aliased_csv(spark, feed.path, feed.aliases, feed.required, feed.fallbacks)
            known = [tables[k].select(F.col("id").alias("region")) for k in feed.knows if k in tables]
            more = [known[0] if len(known) == 1 else reduce(DataFrame.unionByName, known)] if known else []
            valid, rejects = feed.parser(records, *more)
            tables[name], rejects = stash(valid, f"feed-{name}"), stash(rejects, f"rejects-{name}")
        except (AnalysisException, ValueError) as e:
            message = str(e).splitlines()[0]
            report = report.unionByName(spark.createDataFrame([(name, "error", None, None, None, message)], schema))
            continue
        report = report.unionByName(tables[name].agg(F.count(F.lit(1)).alias("rows")).select(*row(name, "loaded", F.col("rows"), none, none, none)))
        report = report.unionByName(headers.select(*row(name, "warning", none, F.col("file"), none, F.col("message"))))
        report = report.unionByName(rejects.select(*row(name, "warning", none, F.col("file"), F.col("line"), F.col("message"))))
    return tables, report


def fallback_dataset(loaded: DataFrame, bundled: DataFrame) -> DataFrame:
    """The loaded rows, or the bundled ones if none was loaded."""
    return bundled if loaded.isEmpty() else loaded.select(*bundled.columns)


def clean_string(name: str) -> Column:
    return coerce_string(F.col(name))

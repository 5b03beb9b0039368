"""Keyword observations from pages, page fingerprints, deduplication across runs, hash-chained ledgers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob.functions.columns import content_key, extract_items, normalize_body, strip_tags
from corrob.sources.shared import stash


def read_pages(pages: DataFrame, tag: str | None = None, klass: str | None = None, most: int | None = None) -> DataFrame:
    """page_id, url, text, content_sha, item_sha: what a page says.

    The text is that of its items (elements ``tag``, with a class if one is given) in their order or, where it has none,
    of the whole page without tags; either is normalised last, and cut at ``most`` characters if a limit is given. The
    fingerprint of the items doesn't depend on their order; it is empty where there are none. A null page is empty.
    """
    html = F.coalesce("html", F.lit(""))
    found = pages.select("page_id", "url", "html", (extract_items(html, tag, klass) if tag else F.array().cast("array<string>")).alias("items"))
    said = F.when(F.size("items") > 0, F.array_join("items", "\n")).otherwise(strip_tags(html))
    each = found.select("page_id", "url", "items", normalize_body(said, most).alias("text"))
    item_sha = F.when(F.size("items") > 0, F.sha2(F.array_join(F.array_sort("items"), "\x1f"), 256)).otherwise("")
    return each.select("page_id", "url", "text", F.sha2("text", 256).alias("content_sha"), item_sha.alias("item_sha"))


def page_fingerprints(pages: DataFrame, tag: str | None = None, klass: str | None = None) -> DataFrame:
    """page_id, fingerprint: of the items, or else of the text."""
    return read_pages(pages, tag, klass).select("page_id", F.coalesce(F.nullif("item_sha", F.lit("")), "content_sha").alias("fingerprint"))


def keyword_observations(pages: DataFrame, keywords: list[str], tag: str | None = None, klass: str | None = None, before: int = 140, after: int = 180, most: int | None = None) -> DataFrame:
    """First hit of each keyword in a page's text: page_id, keyword, excerpt, content_sha, item_sha, fingerprint. One row per hit.

    The fingerprint (of source, keyword, and items or else text) tells an observation of an earlier run again.
    """
    read = read_pages(pages, tag, klass, most)
    at = F.instr(F.lower("text"), F.lower("keyword"))
    hits = read.select("*", F.explode(F.array(*map(F.lit, keywords))).alias("keyword")).withColumn("at", at).where("at > 0")
    start = F.greatest(F.lit(1), F.col("at") - before)
    excerpt = F.trim(F.substring("text", start, F.col("at") - start + F.length("keyword") + after))
    seen_as = content_key(F.col("url"), F.col("keyword"), F.coalesce(F.nullif("item_sha", F.lit("")), "content_sha"))
    return hits.select("page_id", "keyword", excerpt.alias("excerpt"), "content_sha", "item_sha", seen_as.alias("fingerprint"))


def dedupe_against(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys aren't in ``seen``."""
    return new.join(seen.select(*keys).distinct(), keys, "left_anti")


def hash_chain(df: DataFrame, chain: str, order: str, payload: Column, after: DataFrame | None = None) -> DataFrame:
    """chain, order, previous_hash, hash: each record carries the hash of the one before.

    ``after`` (chain, hash) has the last hashes of chains that go on; others begin anew. A chain is sequential by
    nature. Records are sorted within partitions by chain and order, and a worker folds over
    them with one hash in hand, so chains of any length take linear time and no memory.
    """
    each = df.select(chain, order, F.sha2(payload, 256).alias("p"))
    if after is None:
        each = each.withColumn("start", F.lit(""))
    else:
        each = each.join(after.select(chain, F.col("hash").alias("start")), chain, "left").fillna("", ["start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prev = object(), ""
        for b in batches:
            before, hashes = [], []
            for k, p, start in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                prev, last = prev if k == last else start, k
                before.append(prev)
                prev = hashlib.sha256((prev + p).encode()).hexdigest()
                hashes.append(prev)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=[chain, order, "previous_hash", "hash"])

    types = dict(each.dtypes)
    return each.repartition(chain).sortWithinPartitions(chain, order, "p").mapInArrow(run, f"`{chain}` {types[chain]}, `{order}` {types[order]}, previous_hash string, hash string")


def last_hashes(chained: DataFrame, chain: str, order: str) -> DataFrame:
    """chain, hash: where each chain ends."""
    return chained.groupBy(chain).agg(F.max_by("hash", order).alias("hash"))


def verify_chain(chained: DataFrame, chain: str, order: str, payload: Column) -> DataFrame:
    """chain, links, broken, first_broken: links whose hash isn't that of their payload and the one before, or that name another one before.

    A link is checked by itself, so any part of a chain can be: records are dealt by ranges of chain and order, each is held against the one before it in its range, and
    the ends of ranges are exchanged, a row for each chain in a range. ``order`` is unique in a chain.
    """
    own = F.col("hash").eqNullSafe(F.sha2(F.concat("previous_hash", F.sha2(payload, 256)), 256))
    each = chained.select(F.col(chain).alias("c"), F.col(order).alias("o"), "previous_hash", "hash", own.alias("own"))
    dealt = stash(each.repartitionByRange("c", "o").withColumn("range", F.spark_partition_id()), "links")
    inside, between = Window.partitionBy("c", "range").orderBy("o"), Window.partitionBy("c").orderBy("range")
    ends = dealt.groupBy("c", "range").agg(F.max_by("hash", "o").alias("end"), F.min("o").alias("o"))
    ends = ends.withColumn("end", F.coalesce(F.lag("end").over(between), F.lit("")))
    links = dealt.withColumn("inner", F.lag("hash").over(inside)).join(ends, ["c", "range", "o"], "left")
    wrong = ~F.col("own") | ~F.col("previous_hash").eqNullSafe(F.coalesce("inner", "end"))
    told = links.groupBy("c").agg(F.count(F.lit(1)).alias("links"), F.count_if(wrong).alias("broken"), F.min(F.when(wrong, F.col("o"))).alias("first_broken"))
    return told.withColumnRenamed("c", chain)

"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has SLOTS places. Each shard owns ``vnodes`` of them, by hash; a key belongs to the next virtual node
clockwise from its own place. Keys that find their shard full continue clockwise. Shards hold ``n // shards`` keys, the
first ``n % shards`` one more, so counts differ by one at most, and only overflow moves.

The key is the text, so that equal texts share a place and part only where a shard is full. The plan sees one count
per place (SLOTS numbers at most); documents take the planned places by joining on place and rank within it.
A null text has no bytes and is a key of its own. Very long texts count whole: only their size, checksum and hash leave
the reader. Repeated rows are separate documents; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import cells_for, ranked, stash

SLOTS = 16384


def ring(shards: int, vnodes: int = 64, slots: int = SLOTS) -> list[int | None]:
    """The shard with a virtual node at each place, else None; the lowest shard where several meet."""
    out: list[int | None] = [None] * slots
    for s in reversed(range(shards)):
        for v in range(vnodes):
            out[xxhash.xxh64_intdigest(f"shard {s} node {v}") % slots] = s
    return out


def plan(counts: dict[int, int], nodes: list[int | None], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, keys, shard, first slot in the shard), walking clockwise from place 0."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    for s in range(shards):
        if s not in nodes:
            raise ValueError(f"shard {s} has no virtual node of its own")
    used, out = [0] * shards, []
    for place in sorted(counts):
        rank, at = 0, place
        while rank < counts[place]:
            s = nodes[at % len(nodes)]
            n = 0 if s is None else min(counts[place] - rank, room[s] - used[s])
            if n:
                out.append((place, rank, n, s, used[s]))
                rank, used[s] = rank + n, used[s] + n
            at += 1
    return out


def shard(docs: DataFrame, shards: int = 24, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``)."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    place = F.pmod(F.xxhash64("text"), F.lit(SLOTS)).cast("int")
    rows = stash(docs.select("doc_id", (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), place.alias("__place")), "sizes")
    counts = {r["__place"]: r["n"] for r in rows.groupBy("__place").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_place: dict[int, list] = {}
    for s in plan(counts, ring(shards, vnodes), shards):
        by_place.setdefault(s[0], []).append(s[1:])
    steps = spark.createDataFrame(list(by_place.items()), "__place int, __steps array<struct<first:long,n:long,shard:int,slot:long>>")
    # At most SLOTS rows, and SLOTS + shards steps in all.
    placed = ranked(rows, ["__place"], ["text_crc32", "size", "doc_id"], cells_for(max(counts.values(), default=0)), "__rank").join(F.broadcast(steps), "__place")
    placed = placed.withColumn("__s", F.filter("__steps", lambda s: (s["first"] <= F.col("__rank")) & (F.col("__rank") < s["first"] + s["n"]))[0])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__s.shard").alias("shard"),
        (F.col("__s.slot") + F.col("__rank") - F.col("__s.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

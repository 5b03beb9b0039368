"""SimHash near-duplicates by meet-in-the-middle ball hashing, for fingerprints at 3 or fewer differing bits.

Two fingerprints at distance 3 or less meet at a variant within 1 of one and 2 of the other. Every fingerprint emits
its variants; those of a variant are joined there. The ball of radius 2 can be thinned without losing a pair:

* distances 1 and 3 join fingerprints of different parity, so only odd ones need emit two-bit variants, and even ones
  their 64 one-bit variants;
* of three bits, two lie in the same 32-bit half, so two-bit variants within a half suffice;
* distance 2 joins fingerprints of equal parity, which both emit their one-bit variants.

At a variant, any fingerprint within 1 of it (the hub) is within 3 of all others there, so linking all to one hub keeps
every group together with one link a member; each link is verified. At most 1,057 different fingerprints can share a
variant. Components come from alternating large-star and small-star steps, each a join written to the shared folder.

Variants are sorted in their partitions, and a worker streams over them: it holds a few hundred thousand rows, however
large the partition, so the number of tasks is bounded. A fingerprint or component of very many rows isn't a key of a
shuffle (``join_hot``). Very long texts are read whole.

A null or empty text has fingerprint zero, which links like any other. Rows with equal doc_id are one document in a
component. A null doc_id takes part, but is never a component's id while another is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import free_name, join_hot, slices, stash, utf8

RADIUS = 3
SINGLE = [1 << i for i in range(64)]
PAIRS = [SINGLE[h + i] | SINGLE[h + j] for h in (0, 32) for i in range(32) for j in range(i)]
#: Rows that a task of the verification is given, up to MOST_TASKS; rows that its worker holds.
TASK_ROWS, MOST_TASKS, HELD_ROWS = 2_000_000, 50_000, 250_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(text: bytes | None, size: int = 3) -> int:
    """Majority bits of XXH64 (seed 42) over word shingles, A-Z lower-cased; 0 without words."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :])] if len(words) > size else [digest(joined, 42)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``fp`` (the 64 bits as a long), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fps = [_signed(fingerprint_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    return docs.select(key, utf8(text).alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def links(fps: DataFrame, distinct: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """(a, b): links that join each set of different fingerprints reachable over 3 or fewer bits. ``fps``: ``fp``, each once."""
    spark = fps.sparkSession
    odd = F.bit_count("fp") % 2 == 1
    long = lambda xs: F.array(*(F.lit(_signed(x)) for x in xs))
    masks = F.when(odd, long([0, *SINGLE, *PAIRS])).otherwise(long(SINGLE))
    variants = fps.select("fp", F.explode(masks).alias("m")).select(F.expr("fp ^ m").alias("v"), "fp")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-distinct * 560 // TASK_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= held_rows:
                v, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(v, v[-1]))  # the last variant may go on
                yield linked(v[:cut], fp[:cut])
                held, n = [(v[cut:], fp[cut:])], len(v) - cut
        if n:
            yield linked(*(np.concatenate(x) for x in zip(*held)))

    return variants.repartition(tasks, "v").sortWithinPartitions("v").mapInArrow(run, "a long, b long").distinct()


def linked(v, fp) -> pa.RecordBatch:
    """The links (a, b) of fingerprints ``fp`` that meet at variants ``v``, in whose order both are."""
    import numpy as np

    same = v[1:] == v[:-1]
    shared = np.concatenate([same, [False]])[: len(v)] | np.concatenate([[False], same])[: len(v)]
    v, fp = v[shared], fp[shared]
    far = np.bitwise_count((v ^ fp).view(np.uint64))
    order = np.lexsort((fp, far, v))
    v, fp, far = v[order], fp[order], far[order]
    first = np.concatenate([[True], v[1:] != v[:-1]])[: len(v)]
    hub = np.flatnonzero(first)[np.cumsum(first) - 1]
    a, b = fp[hub], fp
    ok = (far[hub] <= 1) & (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS)
    pairs = np.unique(np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an edge (a, b) can reach; roots of their own are not listed."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    was = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stash(small.distinct(), "edges", instead_of=now)
        found = mark(now)
        if found == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = found


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, component_id of each row; fp, component_id): a component's id is the least doc_id in it."""
    each = stash(fingerprints(docs), "fps")
    fps = stash(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct-fps")
    distinct = fps.count()
    tree = components(links(fps.select("fp"), distinct))
    roots = stash(fps.join(tree, fps["fp"] == tree["node"], "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    classes = stash(join_hot(roots.select("fp", "rows", "root"), least, "root", distinct).select("fp", "component_id", "rows"), "classes")
    return join_hot(each, classes, "fp", each.count(), "rows"), classes.select("fp", "component_id")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    each, _ = near_duplicates(docs)
    return each.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most_broadcast: int = 2_000_000) -> DataFrame:
    """``docs`` with one row of each component: that of its least doc_id (one of them, if rows repeat it).

    Rows without doc_id stay only where no row of their component has one, once for each text; those without a text go.
    The ids that go or repeat (8 bytes each) are broadcast up to ``most_broadcast``; beyond it both sides are shuffled.
    """
    each, classes = near_duplicates(docs.select("doc_id", "text"))
    id_, said = free_name(docs, "id"), free_name(docs, "said")
    ids = each.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("own"))
    other = stash(ids.where("not (own and n = 1)"), "not-kept")
    few = (lambda df: F.broadcast(df)) if other.count() <= most_broadcast else (lambda df: df)
    same = F.col("doc_id") == F.col(id_)
    once = docs.where("doc_id is not null").join(few(other.select(id_)), same, "left_anti")
    more = docs.join(few(other.where("own").select(id_)), same, "left_semi").dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id is null and text is not null")
    texts = nameless.select("text", F.col("text").alias(said))
    alone = fingerprints(texts, said).join(classes.where("component_id is null"), "fp").select(said)
    rest = nameless.join(alone, F.col("text") == F.col(said), "left_semi").dropDuplicates(["text"])
    return once.unionByName(more).unionByName(rest)

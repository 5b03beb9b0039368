"""Benchmark decontamination by winnowing, as joins of fingerprints.

Of every WINNOW consecutive hashes of GRAM words the least is kept as a fingerprint, in benchmark items as in
documents, so any GRAM + WINNOW − 1 = 10 consecutive words that both share leave a common fingerprint. Items of fewer
than ten words are one window; all runs of their length are fingerprints. Fingerprints of documents are joined with
those of items; where they meet, the match is extended to the windows around it, which join with the items' windows
word by word, so a collision of hashes changes nothing.

Most fingerprints of documents meet no item. A Bloom filter over the items' fingerprints (``filter_bits`` at most) keeps
those from the shuffle; a benchmark too large for it lets more of them through and changes no result. What is joined
later grows with the shared passages. Documents themselves are never shuffled; results go by the MD5 of the text, so
copies count once until they meet their rows again. A table of up to ``most_broadcast`` rows is broadcast, a larger one
is shuffled.

A null text has no words; nor has an item's. A null item_id counts for hits but isn't listed. Repeated rows give
repeated results; repeated items count once. Very long texts are read whole. Without documents, or without a
benchmark, results are empty or without hits. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import free_name, slices, stash, utf8

WINDOW = 10
GRAM = 5
WINNOW = WINDOW - GRAM + 1
#: A-Z to a-z; ASCII other than letters and digits separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
FOUND = "array<struct<n:int,h:long,starts:array<int>,said:array<binary>>>"


@dataclass(frozen=True)
class WinnowParams:
    """filter_bits: of the Bloom filter, at most (a bit each is sent to every worker); most_broadcast: rows of a side of a join."""

    filter_bits: int = 1 << 27
    most_broadcast: int = 200_000


class Words:
    """The words of a batch of texts: hashes, places and texts (``doc``) as arrays; no object for each word."""

    def __init__(self, texts: pa.Array):
        import numpy as np

        texts = texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        self.folded = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]].translate(FOLD) if texts.buffers()[2] is not None else b""
        offsets -= offsets[0]
        size = len(self.folded)
        code = np.frombuffer(self.folded, np.uint8)
        inside = np.zeros(size + 1, bool)
        inside[:size] = code != 32
        first = np.zeros(size + 1, bool)
        first[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        power, inverse = _powers(size + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[:size], dtype=np.uint64)])
            h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.hashes = h ^ (h >> np.uint64(29))

    def grams(self, n: int):
        """Hashes of all runs of ``n`` words, and which of them lie within one text."""
        import numpy as np

        size = max(0, len(self.hashes) - n + 1)
        out = np.zeros(size, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                out = out * np.uint64(BASE) + self.hashes[i : i + size]
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32)), self.doc[:size] == self.doc[n - 1 : n - 1 + size]

    def winnowed(self):
        """(positions, hashes) of the fingerprints: the least hash (the last of equals) of each WINNOW grams of a text."""
        import numpy as np

        h, _ = self.grams(GRAM)
        if len(h) < WINNOW:
            return np.zeros(0, int), h[:0]
        view = np.lib.stride_tricks.sliding_window_view(h, WINNOW)[:, ::-1]
        whole = self.doc[: len(view)] == self.doc[WINDOW - 1 : WINDOW - 1 + len(view)]
        at = np.zeros(len(h), bool)
        at[(np.arange(len(view)) + WINNOW - 1 - view.argmin(axis=1))[whole]] = True
        at = np.flatnonzero(at)
        return at, h[at]

    def said(self, start: int, n: int) -> bytes:
        return b" ".join(self.folded[self.starts[start] : self.ends[start + n - 1]].split())


_POWERS: list = []


def _powers(n: int):
    """BASE^i and BASE^−i mod 2^64 for i < n; kept for texts of ordinary size."""
    import numpy as np

    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    with np.errstate(over="ignore"):
        both = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(b))]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    if n <= 2 << 20:
        _POWERS[:] = both
    return both


def _bits_of(n: int, h, size: int):
    """Two bits of a filter of ``size`` bits (a power of two) for each fingerprint ``h`` of runs of ``n`` words."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(n)) * np.uint64(0x94D049BB133111EB)
    mask = np.uint64(size - 1)
    return (x >> np.uint64(8)) & mask, (x >> np.uint64(36)) & mask


def item_prints(items: DataFrame) -> DataFrame:
    """n, h, two filter bits of 64: the different fingerprints of items (column ``text``, UTF-8)."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, 1 << 20):
            words = Words(b.column(0))
            h = [(WINDOW, words.winnowed()[1])]
            for n in range(1, WINDOW):
                grams, whole = words.grams(n)
                at = np.flatnonzero(whole)
                h.append((n, grams[at[words.counts[words.doc[at]] == n]]))
            for n, x in h:
                x = np.unique(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), n, np.int32)), pa.array(x.view(np.int64))], names=["n", "h"])

    return items.select("text").mapInArrow(run, "n int, h long").distinct()


def item_windows(items: DataFrame) -> DataFrame:
    """said, item_id: the different windows of items (columns ``item_id`` and ``text``); their words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 20):
            words = Words(b.column(1))
            which, said = [], []
            for d, (at, n) in enumerate(zip(words.first.tolist(), words.counts.tolist())):
                for s in range(max(1, n - WINDOW + 1) if n else 0):
                    which.append(d)
                    said.append(words.said(at + s, min(n, WINDOW)))
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()), b.column(0).take(pa.array(which, pa.int64()))], names=["said", "item_id"])

    return items.select("item_id", "text").mapInArrow(run, "said binary, item_id string").distinct()


def bloom(prints: DataFrame, p: WinnowParams):
    """(words of 64 bits, lengths of short items) of the items' fingerprints. As many rows as the filter has words at most."""
    import numpy as np

    n = prints.count()
    size = min(p.filter_bits, 1 << max(12, math.ceil(math.log2(max(1, n) * 32))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.concatenate(_bits_of(b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy().view(np.uint64), size)) if b.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], names=["at", "bit"])

    rows = prints.mapInArrow(run, "at int, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(size >> 6, np.uint64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    lengths = sorted(r["n"] for r in prints.where(F.col("n") < WINDOW).select("n").distinct().collect())
    return table, lengths


def candidates(docs: DataFrame, keep: list[str], text: str, table, lengths: list[int]) -> DataFrame:
    """``keep``, n_words and ``found``: the fingerprints that pass the filter, each with the windows around it."""
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast(table)

    def passing(n, h):
        one, two = _bits_of(n, h, len(shared.value) << 6)
        is_set = lambda at: (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return np.flatnonzero(is_set(one) & is_set(two))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(keep)
        for b in slices(batches, last, 1 << 20):
            words = Words(b.column(last))
            found: list[list] = [[] for _ in range(b.num_rows)]
            at, h = words.winnowed()
            for k in passing(WINDOW, h).tolist():
                d = words.doc[at[k]]
                around = range(max(words.first[d], at[k] - WINNOW + 1), min(at[k], words.first[d + 1] - WINDOW) + 1)
                found[d].append({"n": WINDOW, "h": int(h[k].view(np.int64)), "starts": [int(s - words.first[d]) for s in around], "said": [words.said(s, WINDOW) for s in around]})
            for n in lengths:
                grams, whole = words.grams(n)
                for k in passing(n, grams).tolist():
                    if whole[k]:
                        d = words.doc[k]
                        found[d].append({"n": n, "h": int(grams[k].view(np.int64)), "starts": [int(k - words.first[d])], "said": [words.said(k, n)]})
            kind = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("starts", pa.list_(pa.int32())), ("said", pa.list_(pa.binary()))]))
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(words.counts.astype(np.int64)), pa.array(found, kind)], names=[*keep, "n_words", "found"])

    columns = docs.select(*keep, utf8(text).alias("__text"))
    return columns.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema[:-1]) + f", n_words long, found {FOUND}")


def text_key(text: str = "text") -> Column:
    """What stands for a text in joins: its MD5, 16 bytes; null of null."""
    return F.unhex(F.md5(text))


def _small(df: DataFrame, p: WinnowParams) -> DataFrame:
    return F.broadcast(df) if df.count() <= p.most_broadcast else df


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], p: WinnowParams = WinnowParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``keep``, ``key`` and n_words of each row; the windows found: key, n, s, said; the windows of items: said, item_id)."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), utf8("text").alias("text")).distinct()
    prints, windows = stash(item_prints(items), "item-prints"), stash(item_windows(items), "item-windows")
    keep = [*keep, "key"]
    read = stash(candidates(docs.withColumn("key", text_key()), keep, "text", *bloom(prints, p)), "candidates")
    met = read.where("size(found) > 0").select("key", F.explode("found").alias("f")).select("key", "f.*").distinct()
    met = met.join(_small(prints, p), ["n", "h"], "left_semi")
    around = met.select("key", "n", F.explode(F.arrays_zip("starts", "said")).alias("w")).select("key", "n", F.col("w.starts").alias("s"), F.col("w.said").alias("said")).distinct()
    # One row per window that an item has, however many have it; the items follow from the windows that were found.
    found = around.join(_small(windows.select("said").distinct(), p), "said", "left_semi")
    return read.select(*keep, "n_words"), stash(found, "found-windows"), windows


def contamination(docs: DataFrame, benchmark: DataFrame, p: WinnowParams = WinnowParams()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found, windows = matches(docs.select("doc_id", "text"), benchmark, ["doc_id"], p)
    spans = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("spans"))  # of one text
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    union = F.aggregate("spans", start, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")))
    named = found.select("key", "said").distinct().join(_small(windows.where("item_id is not null"), p), "said")
    named = named.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))  # of one text
    named = named.select("key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    hit = _small(stash(spans.select("key", union["n"].cast("long").alias("n_hit")).join(named, "key", "left"), "hits"), p)
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.join(hit, "key", "left").select(
        "doc_id", "n_words", n(F.col("n_hit")).alias("n_hit"), n(F.col("n_items")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: WinnowParams = WinnowParams()) -> DataFrame:
    """Rows of ``docs`` (all columns) without a hit word."""
    _, found, _ = matches(docs.select("text"), benchmark, [], p)
    name = free_name(docs, "hit")
    hit = _small(stash(found.select(F.col("key").alias(name)).distinct(), "hits"), p)
    return docs.join(hit, text_key() == F.col(name), "left_anti")

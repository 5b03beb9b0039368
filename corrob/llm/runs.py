"""Periodic runs of words, found in overlapping tiles by octaves of periods.

A run is a stretch of consecutive words with smallest period q, of at least max(24, 3·q) words, that goes on with q on
neither side. Places i where word i equals word i + q make an interval of length − q ≥ 2·q. Periods are taken by octaves
(1 to 7, 8 to 15, 16 to 31, …). For an octave from ``lo`` on, a document is cut into blocks of ``lo`` words (8 at
least); an interval has a whole block, which therefore recurs q words further on. Blocks and what follows at the distances of their
octave are compared by hashes; where they agree, Z-functions to both sides of the block's boundary give how far the
equality really goes, up to the tile's edge, and whether q is the smallest period. So a tile is solved from its own
words, whatever else its document has.

Tiles of documents up to ``whole`` words are solved where the document is read; longer documents are exploded into
tiles, which are dealt out to all tasks. Fragments of intervals are shuffled by document and period and stitched where
they touch. A document is left with its runs' first periods: later words of a run are dropped.

A null text has no words, a document without words no runs. A null doc_id is carried on, and no words of it are
replaced. Very long texts are searched whole. Repeated rows give repeated results. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrob.llm.common import slices, stash, utf8

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the least block: a run of 24 words with period 7 has an interval of 17, so a whole block of 8.
BLOCK = 8


@dataclass(frozen=True)
class RunParams:
    """whole: words of a document that is solved where it is read; tile: words of a tile of longer ones, without overlap."""

    whole: int = 1 << 16
    tile: int = 1 << 16


def octave(k: int) -> tuple[int, int, int]:
    """(least period, first period beyond, words a block) of octave ``k``."""
    return (1, BLOCK, BLOCK) if k == 0 else (BLOCK << (k - 1), BLOCK << k, BLOCK << (k - 1))


def z_function(s: list[int]) -> list[int]:
    """How far ``s`` agrees with itself from each place on; its length at place 0."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def doubled(h, m: int):
    """Hashes of windows of 2·m words from those of m."""
    import numpy as np

    with np.errstate(over="ignore"):
        return _mixed(h[: max(0, len(h) - m)] * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[m:]))


def hashes(x, size: int):
    """Hashes of the windows of ``size`` words (a power of two) of ``x``."""
    import numpy as np

    with np.errstate(over="ignore"):
        h, m = _mixed(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while m < size:
        h, m = doubled(h, m), 2 * m
    return h


def boundary(x, c: int, k: int, periods) -> list[tuple[int, int, int]]:
    """(period, start, end) of the intervals around place ``c`` of ``x`` for those of ``periods`` that are primitive there."""
    import numpy as np

    lo, hi, block = octave(k)
    right = np.array(z_function(x[c : c + 4 * block].tolist()))
    reach = np.arange(len(right)) + right
    # A period whose first words are a whole number of shorter periods is none: the run has a shorter one.
    primitive = np.zeros(hi, bool)
    primitive[periods] = True
    for p in np.flatnonzero(reach[1 : hi // 2 + 1] >= lo) + 1:
        primitive[2 * p : min(hi, reach[p] + 1) : p] = False
    before = x[max(0, c - block) : c][::-1].tolist()
    mirror = x[max(0, c - block) : c + 2 * block][::-1]
    left = z_function([*before, -1, *mirror.tolist()])
    end, out = min(len(x), c + 2 * block), []
    for q in np.flatnonzero(primitive).tolist():
        if q < len(right) and right[q] >= block:  # else only the hashes agreed
            back = min(left[len(before) + 1 + end - c - q], len(before)) if before else 0
            out.append((q, c - back, c + min(int(right[q]), 2 * block)))
    return out


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals of one period that touch, as one."""
    out: list[tuple[int, int, int]] = []
    for q, s, e in sorted(found):
        if out and out[-1][0] == q and s <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((q, s, e))
    return out


def solve(x, k: int, h=None, first: int = 0, last: int | None = None) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of the intervals of octave ``k`` at the blocks of ``x`` from ``first`` on, before ``last``."""
    import numpy as np

    lo, hi, block = octave(k)
    h = hashes(x, block) if h is None else h
    own = h[first:last:block]
    skip = lo if k else 0
    grid = np.zeros(len(own) * block, np.uint64)
    seen = h[first + skip : first + skip + len(grid)]
    grid[: len(seen)] = seen
    same = grid.reshape(len(own), block) == own[:, None]
    if k == 0:
        same[:, 0] = False
    found: list[tuple[int, int, int]] = []
    for j in np.flatnonzero(same.any(axis=1)).tolist():
        found += boundary(x, first + j * block, k, np.flatnonzero(same[j]) + skip)
    return merged(found)


def solve_whole(x) -> list[tuple[int, int, int]]:
    """The intervals of all octaves that make runs, for a document in one piece."""
    out, k, h = [], 0, hashes(x, BLOCK)
    while LEAST_PERIODS * octave(k)[0] <= len(x):
        if k > 1:
            h = doubled(h, octave(k - 1)[2])
        out += [(q, s, e) for q, s, e in solve(x, k, h) if e - s + q >= max(LEAST_WORDS, LEAST_PERIODS * q)]
        k += 1
    return out


def step_of(k: int, size: int) -> int:
    """Words from one tile of octave ``k`` to the next: whole blocks, ``size`` at least."""
    block = octave(k)[2]
    return -(-size // block) * block


def tiles(n: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(octave, first word, end, first block's place in it) of the overlapping tiles of a document of ``n`` words."""
    k = 0
    while LEAST_PERIODS * octave(k)[0] <= n:
        block, step = octave(k)[2], step_of(k, size)
        for at in range(0, n, step):
            start = max(0, at - block)
            yield k, start, min(n, at + step + 3 * block), at - start
        k += 1


def words_of(text: bytes | None, h: int | None) -> list[bytes]:
    """The words of a text; for a tenth of the documents (by ``h``, the CRC of the id) with a period put in."""
    words = (text or b"").split()
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = (words[a : a + p] * -(-(n - a) // p))[: n - a]
    return words


def numbered(words: list[bytes]):
    """Words as numbers, equal ones alike."""
    import numpy as np

    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by blanks, without those that a run (start, length, period) repeats."""
    import numpy as np

    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def cut(docs: DataFrame, p: RunParams = RunParams()) -> DataFrame:
    """One table of three kinds of rows: documents, fragments of intervals, and tiles of long documents.

    ``ref`` numbers documents. Those that surely have no run have no ``words``, but the digest of their text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"ref long, doc_id {kind}, plain string, words binary, period int, start long, `end` long, octave int, block int, tile array<int>"
    kinds = [pa.int64(), None, pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
    names = ["ref", "doc_id", "plain", "words", "period", "start", "end", "octave", "block", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            types = [b.schema.field(1).type if t is None else t for t in kinds]

            def handed(rows, types=types):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

            rows = []
            for ref, doc, text, h in zip(*(b.column(i).to_pylist() for i in range(4))):
                words = words_of(text, h)
                joined = b" ".join(words)
                found = []
                if len(words) > p.whole:
                    x = numbered(words)
                    for k, s, e, block in tiles(len(x), p.tile):
                        yield handed([(ref, None, None, None, None, s, e, k, block, x[s:e])])
                elif len(words) >= LEAST_WORDS:
                    found = solve_whole(numbered(words))
                open_ = len(words) > p.whole or found
                rows.append((ref, doc, None if open_ else hashlib.sha256(joined).hexdigest(), joined if open_ else None, *[None] * 6))
                rows += [(ref, None, None, None, q, s, e, None, None, None) for q, s, e in found]
            yield handed(rows)

    given = docs.select(F.monotonically_increasing_id().alias("ref"), "doc_id", utf8("text").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return given.mapInArrow(run, schema)


def solve_tiles(cut_up: DataFrame, p: RunParams = RunParams()) -> DataFrame:
    """ref, period, start, end of the fragments in the tiles, which are dealt out to tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref, start, k, block, tile in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                x = tile.values.to_numpy()
                rows = [(ref, q, start + s, start + e) for q, s, e in solve(x, k, None, block, block + step_of(k, p.tile))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["ref", "period", "start", "end"])

    dealt = cut_up.where("octave is not null").select("ref", "start", "octave", "block", "tile").repartition("ref", "octave", "start")
    return dealt.mapInArrow(run, "ref long, period int, start long, `end` long")


def stitched(fragments: DataFrame) -> DataFrame:
    """ref, start, length, period of the runs: fragments of a document and period that touch are one interval."""
    one = Window.partitionBy("ref", "period").orderBy("start", "end")
    reach = F.max("end").over(one.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    parts = parts.withColumn("interval", F.sum("new").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("ref", "period", "interval").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = whole.select("ref", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"), F.col("period").cast("long").alias("period"))
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))


def run_table(docs: DataFrame, p: RunParams = RunParams()) -> tuple[DataFrame, DataFrame]:
    """(``cut``, and ref, start, length, period of all runs)."""
    cut_up = stash(cut(docs, p), "run-tiles")
    fragments = cut_up.where("period is not null").select("ref", "period", "start", "end")
    return cut_up, stitched(fragments.unionByName(solve_tiles(cut_up, p)))


def digest(docs: DataFrame, p: RunParams = RunParams()) -> DataFrame:
    """doc_id, n_runs, the run of most periods (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    cut_up, runs = run_table(docs, p)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    each = runs.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))  # of one document
    open_ = cut_up.where("words is not null").select("ref", "doc_id", "words").join(each, "ref", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = []
            for words, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = sorted(((r["start"], r["length"], r["period"]) for r in runs or ()), key=lambda r: (r[0], r[2]))
                best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
                said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                kept = collapse(words.split(b" "), found)
                rows.append((len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    none = F.lit(None).cast("long")
    plain = cut_up.where("plain is not null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"), none.alias("exponent_milli"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"),
    )
    return plain.unionByName(open_.select("doc_id", "words", "runs").mapInArrow(run, schema))

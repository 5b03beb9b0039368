"""Quality rules: statistics of whole texts, fixed limits, and an isolation forest over the statistics.

Random trees split the rule statistics (as shares: word length, symbols, repeated lines, repeated words) of a bounded
sample of all documents that pass the fixed limits; labels play no part in it. Documents that few splits isolate have
short paths and are anomalous. Each tree sees few documents (``sample``), so that many alike bad ones don't hide each
other. Labels calibrate the threshold on the anomaly score alone: over all labelled rows that pass the limits, the best
separation of the two labels among those that lose at most ``most_good_lost`` of the good ones (by a histogram with
fixed bins).

A null text has no words. A text without words fails the base rule. Very long texts are read whole. Without labels of
both kinds, or without labelled rows, the method rejects nothing. A document with contradicting labels counts as bad.
Repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import histogram_threshold, slices, stash, utf8

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_lines")
BINS = 1000


@dataclass(frozen=True)
class ForestParams:
    """trees of depth log2(sample), each on ``sample`` of the ``fit_rows`` documents (about; taken by hash) that are drawn in all; most_good_lost: the share of good labelled rows that the threshold may cost."""

    trees: int = 256
    sample: int = 16
    fit_rows: int = 8192
    seed: int = 7
    most_good_lost: float = 0.005


def statistics_of(raw: bytes | None) -> tuple[int, ...]:
    """STATS of one UTF-8 text."""
    import numpy as np

    raw = raw or b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    points = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\f"))
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeat = 0
    if n > 8:
        with np.errstate(over="ignore"):
            window = np.zeros(n - 7, np.uint64)
            for i in range(8):
                window = window * np.uint64(0x9E3779B97F4A7C15) + (hashes[i : n - 7 + i] ^ (hashes[i : n - 7 + i] >> np.uint64(29)))
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
        if len(count) < len(window):
            edge = np.zeros(n + 1, np.int64)
            starts = np.flatnonzero(count[back] > 1)
            edge[:-8] += np.bincount(starts, minlength=n - 7)
            edge[8:] -= np.bincount(starts, minlength=n - 7)
            repeat = int((np.cumsum(edge) > 0).sum())
    return (
        n, points - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat,
        points, len(lines),
    )


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and STATS, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = [statistics_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[key, *STATS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, utf8(text).alias("text")).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{s} long" for s in STATS))


def features(stats):
    """The forest's columns from an array of STATS: word length, and shares of symbols, repeated lines and repeated words.

    Shares only: very short and very long texts would be anomalies by their size.
    """
    import numpy as np

    w, chars, sym, dup, rep, points, lines = stats.T.astype(float)
    one = lambda x: np.maximum(x, 1)
    return np.stack([chars / one(w), np.log1p(1000 * sym / one(points)), dup / one(lines), rep / one(w)], axis=1)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x, p: ForestParams) -> list[tuple]:
    """Trees over rows ``x`` as arrays (feature, split, left, path length): children are left and left + 1, leaves have feature −1."""
    import numpy as np

    rng, depth = np.random.default_rng(p.seed), max(1, math.ceil(math.log2(max(2, p.sample))))
    out = []
    for _ in range(p.trees):
        todo = [(x[rng.permutation(len(x))[: p.sample]], 0)]
        feature, split, left, path = [], [], [], []
        at = 0
        while at < len(todo):
            rows, level = todo[at]
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            able = np.flatnonzero(hi > lo)
            if level >= depth or not len(able):
                feature.append(-1), split.append(0.0), left.append(at), path.append(level + expected_path(len(rows)))
            else:
                f = int(rng.choice(able))
                s = float(rng.uniform(lo[f], hi[f]))
                feature.append(f), split.append(s), left.append(len(todo)), path.append(0.0)
                todo += [(rows[rows[:, f] <= s], level + 1), (rows[rows[:, f] > s], level + 1)]
                if not len(todo[-1][0]):  # uniform() may return its upper end
                    todo[-1] = todo[-2]
            at += 1
        out.append((np.array(feature), np.array(split), np.array(left), np.array(path), depth))
    return out


def anomaly(x, trees: list[tuple], sample: int):
    """2^(−mean path / expected path): near 1 is anomalous, near 0.5 ordinary."""
    import numpy as np

    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, left, path, depth in trees:
        at = np.zeros(len(x), int)
        for _ in range(depth):
            f = feature[at]
            at = np.where(f < 0, at, left[at] + (x[rows, np.maximum(f, 0)] > split[at]))
        total += path[at]
    return 2.0 ** (-total / max(1, len(trees)) / max(expected_path(sample), 1e-9))


def judge(docs: DataFrame, labels: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """doc_id, STATS, base_failed, score (of anomaly, 0 to 1), kept."""
    import numpy as np

    spark = docs.sparkSession
    stats = stash(statistics(docs), "statistics")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # What fails the base rule is gone already: the forest learns, and its threshold is set, on the rest.
    passed = stats.where(~failed)
    known = stash(known.join(passed, "doc_id").select("good", *STATS), "labelled")
    share = min(1.0, p.fit_rows / max(1, passed.count()))
    draw = F.pmod(F.xxhash64("doc_id", *STATS), F.lit(1 << 30))
    # About fit_rows rows; the limit only guards the driver against an unlucky hash, and takes the same rows each time.
    rows = passed.where(draw < F.lit(int(share * (1 << 30)))).orderBy(draw, *STATS).select(*STATS).limit(2 * p.fit_rows + 100).collect()
    fit = np.array([tuple(r) for r in rows], np.int64).reshape(-1, len(STATS))
    sample = min(p.sample, len(fit))
    trees = spark.sparkContext.broadcast(grow(features(fit), p) if len(fit) else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in STATS], axis=1) if b.num_rows else np.zeros((0, len(STATS)))
            score = anomaly(features(x), trees.value, sample) if trees.value else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    scored = lambda df: df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", score double")
    bins = scored(known).groupBy(F.floor(F.col("score") * (BINS - 1)).cast("int").alias("bin")).agg(F.count_if(F.col("good") > 0).alias("good"), F.count_if(F.col("good") <= 0).alias("bad")).collect()
    good, bad = [0] * BINS, [0] * BINS
    for r in bins:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    at = histogram_threshold(good, bad, p.most_good_lost)
    anomalous = F.lit(False) if at is None else F.floor(F.col("score") * (BINS - 1)) >= at
    return scored(stats).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~anomalous)

"""Quality classifier by hierarchical empirical Bayes: document evidence with host- and path-level posteriors.

A document is good if it is neither of low quality nor toxic; each of the two has its own evidence. Evidence is the sum
of log-likelihood ratios of the words (and of a few shape classes) that a document has, in 2^BITS hashed cells, counted
over all labelled documents by grouped aggregation. Ratios are shrunk by pseudo-counts toward none, and those within
``least_z`` of chance, at 2^BITS cells and words that come in passages, are none. One fold of the labelled rows, which
the counts leave out, scales each sum to a logit (two coefficients, over a histogram); a document's probability of being
good is the product of both.

Sites: a document's host is its ``source``, its path ``source`` and ``lang``. The share of good labelled documents of
each host is shrunk toward the global share, and that of each path toward its host's, with strengths estimated from
the spread between groups (method of moments); a site without labels takes its parent's value, so a sparse one is near
it. The score adds the site's shift of the logit to the document's. The threshold is the best separation on the scaling
fold that loses at most ``most_good_lost`` of the good.

Contradicting labels count as the worse. Null text: no words. Very long texts are read whole. Null source or lang: a
site of its own. A kind of label that isn't there in both values has no evidence; without good and bad labels all
documents are kept with score 0.5. Repeated rows give repeated results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import histogram_threshold, slices, stash, utf8

BITS = 18
EVIDENCE_BINS, SCORE_BINS, RANGE = 2001, 1001, 100.0
PARTS = ("low", "toxic")


@dataclass(frozen=True)
class SiteParams:
    """pseudo: counts that each cell has beforehand; least_z: of a cell that counts; folds: one of so many scales; most_broadcast, most_labels: rows of sites and of labels (16 bytes each) up to which a join broadcasts them."""

    pseudo: float = 2.0
    least_z: float = 6.0
    clip: float = 6.0
    folds: int = 4
    most_good_lost: float = 0.005
    most_broadcast: int = 100_000
    most_labels: int = 2_000_000


def cells_of(raw: bytes | None) -> list[int]:
    """Cells of the different words (lower-cased, outer punctuation removed) and shape classes of a text."""
    raw = raw or b""
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    distinct = {w.strip(b".,;:!?\"'()") for w in raw.lower().split()}
    shapes = (
        (b"few", min(len(words) // 5, 8)),
        (b"caps", 10 * (size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) // size),
        (b"marks", min(9, 40 * (size - len(raw.translate(None, b"#*$%&|<>!"))) // size)),
        (b"fresh", 10 * len(distinct) // n if len(words) >= 50 else -1),
    )
    names = [w for w in distinct if w] + [b"\x00%s %d" % s for s in shapes]
    return sorted({zlib.crc32(w) >> (32 - BITS) for w in names})


def platt(x, good, bad) -> tuple[float, float]:
    """(a, b) of the logistic curve through counts of good and bad at x, lightly ridged."""
    import numpy as np

    a, b, n = 0.1, 0.0, good + bad
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((good - n * p) * x).sum() - 1e-3 * a, (good - n * p).sum() - 1e-3 * b])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
    return max(0.0, float(a)), float(b)


def ratios(total, bad, n: int, n_bad: int, p: SiteParams):
    """The shrunk log-likelihood ratio of each cell, good over bad; 0 within chance. total, bad: documents that have it."""
    import numpy as np

    share, good = 1 - n_bad / n, total - bad
    ratio = np.log((good + p.pseudo * share) / (n - n_bad)) - np.log((bad + p.pseudo * (1 - share)) / n_bad)
    z = (good - total * share) / np.sqrt(total * share * (1 - share))
    return np.where(np.abs(z) >= p.least_z, np.clip(ratio, -p.clip, p.clip), 0.0)


def classify(docs: DataFrame, labels: DataFrame, p: SiteParams = SiteParams()) -> DataFrame:
    """doc_id, low_evidence, toxic_evidence, host_posterior, path_posterior, score (probability of good), kept."""
    import numpy as np

    spark = docs.sparkSession

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([cells_of(t) for t in b.column(3).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "host", "path", "cells"])

    site = docs.select("doc_id", F.concat(F.lit("h"), F.coalesce("source", F.lit("\x00"))).alias("host"), F.coalesce("lang", F.lit("\x00")).alias("path"), utf8("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = stash(site.mapInArrow(cells, f"doc_id {kind}, host string, path string, cells array<int>"), "cells")
    low, toxic = F.col("quality") != 1, F.coalesce("toxic", F.lit(0)) != 0
    flags = F.max(low).cast("int") + 2 * F.max(toxic).cast("int")  # one number, so that what is broadcast is small
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(flags.alias("flags"))
    if labels.count() <= p.most_labels:  # beyond it, both sides are shuffled
        known = F.broadcast(known)
    known = read.join(known, "doc_id").withColumns({"low": F.col("flags") % 2 == 1, "toxic": F.col("flags") >= 2, "good": F.col("flags") == 0}).drop("flags")
    known = stash(known.withColumn("later", F.pmod(F.xxhash64("doc_id"), F.lit(p.folds)) == 0), "labelled")
    first = known.where("not later")
    n, n_good, *n_bad = first.agg(F.count(F.lit(1)), F.count_if("good"), *(F.count_if(k) for k in PARTS)).first()
    # 2^BITS rows at most.
    count = first.select(*PARTS, F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(k).alias(k) for k in PARTS)).toPandas()
    weights = np.zeros((2, 1 << BITS))
    for i, k in enumerate(PARTS):
        if 0 < n_bad[i] < n:
            weights[i, count["cell"].to_numpy()] = ratios(count["n"].to_numpy(float), count[k].to_numpy(float), n, n_bad[i], p)
    shared = spark.sparkContext.broadcast(weights)  # fixed size

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            at = lists.flatten().to_numpy()
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            sums = [np.diff(np.append(0.0, np.cumsum(w[at]))[ends]) for w in shared.value]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, sums)], names=[*b.schema.names[:-1], *(f"{k}_evidence" for k in PARTS)])

    def weighed(df: DataFrame) -> DataFrame:
        df = df.select(*(x for x in df.columns if x != "cells"), "cells")
        return df.mapInArrow(weigh, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "cells"] + [f"{k}_evidence double" for k in PARTS]))

    step = 2 * RANGE / (EVIDENCE_BINS - 1)
    held = stash(weighed(known.where("later")), "scaling")
    lines = {}
    for i, k in enumerate(PARTS):
        bin_ = F.floor((F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col(f"{k}_evidence"))) + RANGE) / step + 0.5).cast("int")
        hist = held.groupBy(bin_.alias("bin")).agg(F.count_if(~F.col(k)).alias("g"), F.count_if(k).alias("b")).toPandas()  # EVIDENCE_BINS rows at most
        if len(hist) and hist["g"].sum() and hist["b"].sum() and 0 < n_bad[i] < n:
            lines[k] = platt(hist["bin"].to_numpy(float) * step - RANGE, hist["g"].to_numpy(float), hist["b"].to_numpy(float))

    # Sites: counts by path, summed to hosts; strengths come from sums over groups.
    paths = stash(first.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("good").cast("double").alias("k")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    mean = n_good / n if 0 < n_good < n else 0.5

    def strength(df: DataFrame, n: str, k: str, parent) -> float:
        s = df.select(F.col(n).alias("n"), F.col(k).alias("k"), parent.alias("p")).agg(
            F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("nn"), F.sum(F.col("p") * (1 - F.col("p"))).alias("inside"),
            F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("p")) ** 2).alias("spread"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("var"),
        ).first()
        return strength_from(*(float(x or 0) for x in s))

    s = strength(hosts, "hn", "hk", F.lit(mean))
    hosts = stash(hosts.select("host", ((F.col("hk") + s * mean) / (F.col("hn") + s)).alias("host_posterior")), "host-posteriors")
    paths = paths.join(hosts, "host")
    s = strength(paths, "n", "k", F.col("host_posterior"))
    paths = stash(paths.select("host", "path", ((F.col("k") + s * F.col("host_posterior")) / (F.col("n") + s)).alias("path_posterior")), "path-posteriors")
    if paths.count() <= p.most_broadcast:  # beyond it, a shuffled join whose skewed partitions Spark splits
        hosts, paths = F.broadcast(hosts), F.broadcast(paths)

    safe = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    logit = lambda x: F.log(safe(x) / (1 - safe(x)))
    good = F.lit(1.0)
    for k, (slope, base) in lines.items():
        good = good / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * F.col(f"{k}_evidence") + base))))
    of_text = logit(good) if lines else F.lit(0.0)

    def scored(df: DataFrame) -> DataFrame:
        df = df.join(hosts, "host", "left").join(paths, ["host", "path"], "left").withColumn("host_posterior", F.coalesce("host_posterior", F.lit(mean)))
        df = df.withColumn("path_posterior", F.coalesce("path_posterior", "host_posterior"))
        return df.withColumn("score", 1 / (1 + F.exp(logit(F.lit(mean)) - logit(F.col("path_posterior")) - of_text)))

    # Bins by the logarithm of −ln(score), so that scores near 1 are told apart.
    level = F.least(F.lit(SCORE_BINS - 1), F.floor(F.log1p(-1000 * F.log(F.greatest(F.lit(1e-300), F.col("score")))) * 80)).cast("int")
    good_by, bad_by = [0] * SCORE_BINS, [0] * SCORE_BINS
    for r in scored(held).groupBy(level.alias("bin")).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).collect():
        good_by[r["bin"]], bad_by[r["bin"]] = r["g"], r["b"]
    worst = histogram_threshold(good_by, bad_by, p.most_good_lost) if lines else None
    return scored(weighed(read)).select("doc_id", *(f"{k}_evidence" for k in PARTS), "host_posterior", "path_posterior", "score", (F.lit(True) if worst is None else level < worst).alias("kept"))


def strength_from(n: float, nn: float, inside: float, spread: float, var: float) -> float:
    """The prior strength (in labels) that the spread of shares between groups suggests, from 1 to 10,000.

    n, nn: sums of group sizes and of their squares; inside, var: sums of p(1 − p), plain and by size; spread: the sum of n·(share − p)².
    """
    weight = n - nn / n if n else 0.0
    between = (spread - inside) / weight if weight > 0 else 0.0
    return min(10_000.0, max(1.0, var / n / between - 1)) if between > 0 else 10_000.0

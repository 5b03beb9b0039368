"""Language identification by string kernels: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression.

Two texts are as similar as their sets of character n-grams (1 to 4, lower-cased, over runs of letters) overlap:
|A ∩ B| / √(|A|·|B|). Similarities to a fixed number of landmark texts span the Nyström feature space, in which ridge
regression is fitted one language against the rest. Whole batches of texts are scored by two matrix products. A long
text would have most n-grams of any language, so texts are scored by stretches of about 2,000 letters, all of them, and
their scores are averaged.

The regression, the shares of n-grams and the thresholds rest on every stretch of every different text of the learning
documents: tasks add up their parts of the normal equations and counts, Spark adds those, and the driver solves a system of
fixed size. A text counts once, however long and however many its copies. Only the landmarks, which span the feature space, are
picked from a sample drawn by hash, about ``per_lang`` texts a language. Languages beyond the ``most_langs`` with most different texts are not learnt. Every text is scored whole,
however long. A null text, or one without a letter, is ``und`` with score 0, as is every text
where there is nothing to learn from. Ties go to the language first in order. Repeated rows give repeated results.

The ridge scores of a text sum to about 1 whatever it says, so they can't tell that a text has none of the languages.
``keep_identified`` asks besides how usual a text's n-grams are: the mean log share of learning texts that have them, in
the language where that is highest. The least that passes is calibrated by number of n-grams on the learning rows, each
left out of its own counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrob.llm.common import free_name, slices, stash, utf8

UNDETERMINED = "und"
BITS = 14
NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class KernelParams:
    """per_lang: texts a language to pick landmarks from, fewer where there are so many that they'd be more than ``most_rows`` in all;
    most_langs: languages learnt; stretch: letters of a text that are scored at once; landmarks: in all, one a language at least;
    ridge: of the regression; sizes: of n-grams.

    lost: the share of learning rows that calibrates the rejection (about what it costs in clean documents, at most);
    slack: how far from there to what a text of all n-grams gets the threshold lies;
    twice that at lengths of which there are few rows.
    """

    per_lang: int = 400
    most_rows: int = 4000
    most_langs: int = 1000
    stretch: int = 2000
    landmarks: int = 192
    ridge: float = 0.1
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    batch: int = 256
    lost: float = 0.005
    slack: float = 0.15


def letters(raw: bytes | None):
    """The code points of a text's letters, lower-cased, with one blank for anything else; None if it has no letter."""
    import numpy as np

    text = NOT_LETTERS.sub(" ", raw.decode("utf-8", "replace").lower()) if raw else ""
    return np.frombuffer(f" {text.strip()} ".encode("utf-32-le"), "<u4") if text.strip() else None


def stretches(code, length: int) -> list:
    """``code`` in equal parts of about ``length``: a presence of n-grams tells little once most of them are there."""
    import numpy as np

    return np.array_split(code, max(1, round(len(code) / length)))


def grams(code, sizes: tuple[int, ...]):
    """The cells (of 2^BITS) of n-grams that occur in a stretch."""
    import numpy as np

    seen = np.zeros(1 << BITS, bool)
    h = np.zeros(len(code), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            if len(code) < n:
                break
            h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
            if n in sizes:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                seen[x >> np.uint32(32 - BITS)] = True
    return seen


def is_held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, p: KernelParams = KernelParams()):
    """(languages, normalised presence rows, one-hot languages of the rows) from ``text`` and ``lang``, or None without any."""
    import numpy as np

    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("__hash"))
    # Sketches, so that counting different texts shuffles a row a language and task; they err by a few percent.
    counts = known.groupBy("lang").agg(F.approx_count_distinct("__hash").alias("n")).orderBy(F.col("n").desc(), "lang").limit(p.most_langs).collect()
    if not counts:
        return None
    each = max(1, min(p.per_lang, p.most_rows // len(counts)))
    rates = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, each / max(1, r["n"] * 0.9)) * (1 << 30)))))
    # Drawn by hash, and the copies of a drawn text are one before any worker reads it.
    drawn = known.where(F.pmod("__hash", F.lit(1 << 30)) < F.try_element_at(rates, F.col("lang"))).select("lang", "text").distinct()

    def drawn_of(text: bytes) -> bytes | None:
        """One stretch of a text, drawn by its checksum."""
        code = letters(text)
        if code is None:
            return None
        parts = stretches(code, p.stretch)
        return np.packbits(grams(parts[zlib.crc32(text) % len(parts)], p.sizes)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            packed = [drawn_of(t) for t in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["lang", "grams"])
            yield out.filter(out.column(1).is_valid())

    # 2 KB a text; the limit only guards the driver against an unlucky hash, and takes the same rows each time.
    rows = drawn.select("lang", utf8("text").alias("text")).mapInArrow(run, "lang string, grams binary").distinct()
    rows = rows.orderBy(F.xxhash64("grams", "lang"), "lang").limit(2 * each * len(counts) + 1000).collect()
    rows = sorted((r["lang"], bytes(r["grams"])) for r in rows)
    if not rows:
        return None
    langs = sorted({k for k, _ in rows})
    x = np.stack([np.unpackbits(np.frombuffer(g, np.uint8)) for _, g in rows]).astype(np.float32)
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    return langs, x, np.array([[float(k == lang) for lang in langs] for k, _ in rows])


def fit(drawn, p: KernelParams = KernelParams()):
    """(languages, landmark rows, coefficients) from what ``sample`` drew; None of None."""
    import numpy as np

    if drawn is None:
        return None
    langs, x, y = drawn
    weight = 1 / y.sum(axis=0)[y.argmax(axis=1)]
    z, root = basis(drawn, p)  # as many landmarks of each language, spread over its sorted sample
    phi = np.hstack([(x @ z).astype(np.float64) @ root, np.ones((len(x), 1))])
    w = weight[:, None] * len(langs) / weight.sum() * len(x) / len(langs)
    coef = np.linalg.solve(phi.T @ (phi * w) + p.ridge * np.eye(phi.shape[1]), phi.T @ (y * w))
    return langs, z, np.vstack([root @ coef[:-1], coef[-1:]]).astype(np.float32)


def gate(drawn, p: KernelParams = KernelParams()):
    """(log share of learning texts that have a cell, by cell and language; bits of the number of cells, and least mean there)."""
    import numpy as np

    if drawn is None:
        return None
    _, x, y = drawn
    roots = 1 / x.max(axis=1)  # √|A|
    counts = np.stack([(x[y[:, i] > 0] > 0).sum(axis=0) for i in range(y.shape[1])], axis=1)
    n = y.sum(axis=0)
    share = np.log((counts + 0.5) / (n + 1)).astype(np.float32)
    without = np.log((np.maximum(counts - 1, 0) + 0.5) / n).astype(np.float32)
    usual = np.where(y > 0, x @ without, x @ share).max(axis=1) / roots
    least_of_all = float(share.mean(axis=0).max())
    bits = np.log2(roots**2 + 0.5).astype(int)
    at, least = [], []
    for k in np.unique(bits):
        # With its neighbours too, so that a bin of few rows isn't judged by those alone.
        q = min(float(np.quantile(v, p.lost, method="lower")) for v in (usual[bits == k], usual[np.abs(bits - k) <= 1]))
        at.append(k + 0.5)
        few = np.count_nonzero(bits == k) * p.lost < 1  # too few for that quantile: twice the slack
        least.append(q + (1 + few) * p.slack * (least_of_all - q))
    # Longer texts have rarer n-grams. Towards those longer than any that was drawn, it falls halfway to that of all n-grams.
    return share, np.array([*at, BITS + 0.5]), np.array([*least, (least[-1] + least_of_all) / 2])


def basis(drawn, p: KernelParams = KernelParams()):
    """(landmark rows as columns, K_zz^(−1/2)) of what ``sample`` drew."""
    import numpy as np

    _, x, y = drawn
    each = max(1, p.landmarks // y.shape[1])
    pick = np.concatenate([at[np.linspace(0, len(at) - 1, min(each, len(at))).astype(int)] for at in (np.flatnonzero(y[:, i]) for i in range(y.shape[1]))])
    z = x[np.unique(pick)]
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    return z.T.copy(), vector[:, good] / np.sqrt(value[good])


def batched(batches: Iterator[pa.RecordBatch], p: KernelParams):
    """Batches of stretches of the texts in (lang, text): (numbers of languages, shares of their texts, presence of cells)."""
    import numpy as np

    of, share, seen = [], [], []
    for b in slices(batches, 1):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            code = letters(text)
            parts = stretches(code, p.stretch) if code is not None else ()
            for part in parts:
                of.append(lang)
                share.append(1 / len(parts))
                seen.append(grams(part, p.sizes))
                if len(of) >= p.batch:
                    yield np.array(of), np.array(share), np.stack(seen).astype(np.float32)
                    of, share, seen = [], [], []
    if of:
        yield np.array(of), np.array(share), np.stack(seen).astype(np.float32)


def added(parts: DataFrame) -> DataFrame:
    """lang, v of ``parts`` (lang, v: doubles as bytes) with the vectors of each number added up; a worker holds one sum a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(v)
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "v"])

    return parts.repartition("lang").mapInArrow(run, "lang int, v binary")


def learn(docs: DataFrame, p: KernelParams = KernelParams(), gated: bool = True):
    """(model, gate) for ``predictor``, from all of ``docs``; the gate only if ``gated``. Both None where nothing can be learnt.

    ``fit`` and ``gate`` say the same of rows that the driver holds.
    """
    import numpy as np

    drawn = sample(docs, p)
    if drawn is None:
        return None, None
    langs, spark = drawn[0], docs.sparkSession
    z, root = basis(drawn, p)
    number = F.create_map(*(F.lit(v) for i, k in enumerate(langs) for v in (k, i)))
    texts = docs.where("text is not null").select(F.try_element_at(number, F.col("lang")).alias("lang"), "text").where("lang is not null").distinct()
    texts = stash(texts.select("lang", utf8("text").alias("text")), "learning")
    n = np.zeros(len(langs))
    for r in texts.groupBy("lang").count().collect():
        n[r["lang"]] = r["count"]
    weight = n.sum() / len(langs) / np.maximum(n, 1)
    d, cells = root.shape[1] + 1, 1 << BITS
    given = spark.sparkContext.broadcast((z, root, weight))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, root, weight = given.value
        square, by_lang = np.zeros((d, d)), {}
        for of, share, x in batched(batches, p):
            phi = np.hstack([(x @ z / np.sqrt(x.sum(axis=1, keepdims=True))).astype(np.float64) @ root, np.ones((len(x), 1))])
            w = weight[of] * share
            square += phi.T @ (phi * w[:, None])
            for k in np.unique(of):
                mine = of == k
                sums = np.concatenate([[share[mine].sum()], w[mine] @ phi[mine], share[mine].astype(np.float32) @ x[mine]])
                by_lang[int(k)] = by_lang[int(k)] + sums if k in by_lang else sums
        by_lang[-1] = square.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(by_lang), pa.int32()), pa.array([v.tobytes() for v in by_lang.values()], pa.binary())], names=["lang", "v"])

    # 130 KB a language, and one matrix of fixed size.
    sums = {r["lang"]: np.frombuffer(r["v"]) for r in added(texts.mapInArrow(equations, "lang int, v binary")).collect()}
    size, right, counts = np.zeros(len(langs)), np.zeros((d, len(langs))), np.zeros((cells, len(langs)))
    for k, v in sums.items():
        if k >= 0:
            size[k], right[:, k], counts[:, k] = v[0], v[1 : 1 + d], v[1 + d :]
    coef = np.linalg.solve(sums[-1].reshape(d, d) + p.ridge * np.eye(d), right)
    model = langs, z, np.vstack([root @ coef[:-1], coef[-1:]]).astype(np.float32)
    if not gated:
        return model, None
    share_of = np.log((counts + 0.5) / (size + 1)).astype(np.float32)
    known = spark.sparkContext.broadcast((counts.astype(np.float32), size, share_of))

    def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size, share_of = known.value
        for of, share, x in batched(batches, p):
            mean = x @ share_of
            for i, (k, w) in enumerate(zip(of, share)):  # in its own language, without itself
                on = x[i] > 0
                mean[i, k] = np.log((np.maximum(counts[on, k] - w, 0) + 0.5) / (size[k] + 1 - w)).sum()
            there = x.sum(axis=1)
            out = [pa.array(np.log2(there + 0.5).astype(np.int32)), pa.array(np.floor(mean.max(axis=1) / there * 1000).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["bits", "usual"])

    # Thousandths: some thousands of different values a number of bits.
    found = texts.mapInArrow(usual, "bits int, usual int").groupBy("bits", "usual").count().collect()
    seen = {}
    for r in found:
        seen.setdefault(r["bits"], []).append((r["usual"], r["count"]))

    def lowest(values: list) -> float:
        """What ``lost`` of the rows are below."""
        values = np.array(sorted(values))
        rows = np.cumsum(values[:, 1])
        return values[np.searchsorted(rows, int(p.lost * (rows[-1] - 1)), side="right"), 0] / 1000

    least_of_all = float(share_of.mean(axis=0).max())
    at, least = [], []
    for k in sorted(seen):
        # With its neighbours too, so that a bin of few rows isn't judged by those alone.
        q = min(lowest(seen[k]), lowest([v for j in (k - 1, k, k + 1) for v in seen.get(j, [])]))
        few = sum(c for _, c in seen[k]) * p.lost < 1  # too few for that quantile: twice the slack
        at.append(k + 0.5)
        least.append(q + (1 + few) * p.slack * (least_of_all - q))
    return model, (share_of, np.array([*at, BITS + 0.5]), np.array([*least, (least[-1] + least_of_all) / 2]))


def predictor(spark: SparkSession, model, p: KernelParams = KernelParams(), usual=None):
    """A function from a column of UTF-8 texts to struct(lang, score, usual). The model (some MB, fixed size) is broadcast.

    A text's scores are the means over its stretches. ``usual`` is true where the gate of that name lets half of them
    pass, or without one.
    """
    import numpy as np
    shared = spark.sparkContext.broadcast((model, usual))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            fitted, asked = shared.value
            n = len(texts)
            if not fitted:
                yield pd.DataFrame({"lang": [UNDETERMINED] * n, "score": [0.0] * n, "usual": [True] * n})
                continue
            langs, z, coef = fitted
            total, parts, passed = np.zeros((n, len(langs))), np.zeros(n), np.zeros(n)

            def add(of: list[int], seen: list) -> None:
                x = np.stack(seen).astype(np.float32)
                size = x.sum(axis=1)
                np.add.at(parts, of, 1)
                if asked:
                    share, at, least = asked
                    np.add.at(passed, of, (x @ share).max(axis=1) / size >= np.interp(np.log2(size), at, least))
                x /= np.sqrt(size[:, None])
                np.add.at(total, of, x @ z @ coef[:-1] + coef[-1])

            of, seen = [], []
            for i, t in enumerate(texts):
                code = letters(t)
                for part in stretches(code, p.stretch) if code is not None else ():
                    of.append(i)
                    seen.append(grams(part, p.sizes))
                    if len(of) >= p.batch:
                        add(of, seen)
                        of, seen = [], []
            if of:
                add(of, seen)
            known = parts > 0
            mean = total / np.maximum(parts, 1)[:, None]
            lang = np.where(known, np.array(langs, object)[mean.argmax(axis=1)], UNDETERMINED)
            score = np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)
            yield pd.DataFrame({"lang": lang, "score": score, "usual": (2 * passed >= parts) if asked else np.ones(n, bool)})

    return F.pandas_udf(run, "lang string, score double, usual boolean")


def identify(docs: DataFrame, p: KernelParams = KernelParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from documents that aren't held out, predicted for all."""
    found = predictor(docs.sparkSession, learn(docs.where(~is_held_out()), p, gated=False)[0], p)
    out = docs.select("doc_id", is_held_out().alias("held_out"), found(utf8("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.9, p: KernelParams = KernelParams()) -> DataFrame:
    """Rows of ``docs`` (all columns) whose text has a language.

    Those that are ``und``, score below ``least`` times what all learnt languages would share equally, or have n-grams
    too unusual for every learnt language go.
    """
    model, usual = learn(docs.where(~is_held_out()), p)
    found = predictor(docs.sparkSession, model, p, usual)
    told = free_name(docs, "language")
    marked = docs.withColumn(told, found(utf8("text")))
    enough = F.col(f"{told}.score") >= least / max(1, len(model[0]) if model else 1)
    return marked.where((F.col(f"{told}.lang") != UNDETERMINED) & enough & F.col(f"{told}.usual")).select(*docs.columns)

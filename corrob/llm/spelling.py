"""Spelling variants: words at one edit from each other, found by pivotal grams and grouped under their commonest form.

Bigrams are ordered from rare to common. A word's gram prefix are its rarest bigrams until they occur in it three times,
so there are two disjoint ones among them; dynamic programming chooses the pair of least cost, of which the first is the
leftmost of its kind and the second the rightmost. One edit lies behind the first pivot or before the second. So one of
them stays, at the same distance from the start or from the end, with all characters on its far side; and if the other
word's prefix ends no earlier in the order, that pivot is in its prefix, leftmost or rightmost there too. The pivots of
each word are therefore joined with the prefixes of others by gram, position and the text on the far side. Of what is
left beside the pivot, one half stays as well; each half makes a key, so that words with common beginnings don't meet all
at once. Pairs that meet are verified.

A null text has no words; a null doc_id deletes no code points. Very long texts and words are taken whole. Repeated rows
count as often as they are there. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import slices, stash, utf8


@dataclass(frozen=True)
class SpellingParams:
    """letters and least_occurrences of a word; times: how much commoner a form is; one in ``damaged`` runs loses a code point.

    held: different words that a task counts before it hands them on. Words need four letters to have two disjoint bigrams
    among any three."""

    letters: int = 5
    least_occurrences: int = 3
    times: int = 2
    damaged: int = 97
    held: int = 200_000

    def __post_init__(self):
        if self.letters < 4:
            raise ValueError("words need four letters")


def runs_of(text: bytes, doc_id, p: SpellingParams) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, those with a deleted code point as they are then."""
    found = Counter(re.findall(f"[a-zÀ-ÿ]{{{p.letters},}}", text.lower().decode("utf-8", "replace")))  # bytes: A-Z only
    so_far = zlib.crc32(f"{doc_id}:".encode())
    for run, n in found.items():
        if doc_id is not None and not (h := zlib.crc32(run.encode(), so_far)) % p.damaged:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < p.letters:
                continue
        yield run, n


def words(docs: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n: the words of all texts with their occurrences; counted in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in slices(batches, 1):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in runs_of(text or b"", doc_id, p):
                    seen[word] = seen.get(word, 0) + n
                if len(seen) >= p.held:
                    yield handed()
        yield handed()

    each = docs.select(F.col("doc_id").cast("string").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least_occurrences)


def gram_costs(known: DataFrame) -> dict[str, int]:
    """How many places in different words each bigram has: as many numbers as pairs of the alphabet's 90 letters at most."""
    places = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    return {r["gram"]: r["n"] for r in known.select(F.explode(places).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def prefix(word: str, rank: dict[str, int]) -> list[str]:
    """The rarest bigrams of ``word`` until they have three places in it; by rank."""
    places = Counter(word[i : i + 2] for i in range(len(word) - 1))
    out, n = [], 0
    for gram in sorted(places, key=rank.__getitem__):
        if n < 3:
            out.append(gram)
            n += places[gram]
    return out


def pivots(word: str, grams: list[str], cost: dict[str, int]) -> tuple[int, int]:
    """Places of two disjoint grams of least cost, the first leftmost and the second rightmost of its kind.

    Places are gone through in order: the cheapest first gram that ends before a place, and the cheapest pair up to it.
    """
    firsts = sorted((word.find(g), cost[g]) for g in grams)
    seconds = sorted((word.rfind(g), cost[g]) for g in grams)
    best, least, k = None, None, 0
    for at, price in seconds:
        while k < len(firsts) and firsts[k][0] + 2 <= at:
            if least is None or firsts[k][1] < least[0]:
                least = (firsts[k][1], firsts[k][0])
            k += 1
        if least is not None and (best is None or least[0] + price < best[0]):
            best = (least[0] + price, least[1], at)
    return best[1:]


def keys(word: str, at: int, lengths: tuple[int, ...], side: str) -> set[int]:
    """Keys of the gram at ``at``, for an edit behind it, where the rest of the other word has one of ``lengths``.

    Either the first half of that rest stays or the second; halves are those of the word whose pivot it is.
    """
    import xxhash

    stem, rest = word[: at + 2], word[at + 2 :]
    out = set()
    for m in lengths:
        half = m // 2
        if 0 <= half <= len(rest):
            out.add(f"{side}{at}<{stem}{rest[:half]}")
        if 0 < m and m - half <= len(rest):
            out.add(f"{side}{at}>{stem}.{rest[len(rest) - m + half :]}")
    return {xxhash.xxh64_intdigest(k.encode()) - (1 << 63) for k in out}


def entries(word: str, rank: dict[str, int], cost: dict[str, int]) -> tuple[int, set[int], set[int]]:
    """(rank of the last gram of the prefix, keys of the pivots, keys of the prefix)."""
    grams = prefix(word, rank)
    back, n = word[::-1], len(word)
    first, second = pivots(word, grams, cost)
    own = keys(word, first, (n - first - 2,), "l") | keys(back, n - second - 2, (second,), "r")
    others: set[int] = set()
    for g in grams:
        left, right = word.find(g), word.rfind(g)
        others |= keys(word, left, tuple(n - left - 2 + d for d in (-1, 0, 1)), "l") | keys(back, n - right - 2, tuple(right + d for d in (-1, 0, 1)), "r")
    return rank[grams[-1]], own, others


def near(known: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words at one edit, once. ``known``: word, n; words of four letters or more."""
    cost = gram_costs(known)
    rank = {g: i for i, g in enumerate(sorted(cost, key=lambda g: (cost[g], g)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, last, key, pivot = [], [], [], []
            for i, word in enumerate(b.column(0).to_pylist()):
                end, own, others = entries(word, rank, cost)
                at += [i] * (len(own) + len(others))
                last += [end] * (len(own) + len(others))
                key += [*own, *others]
                pivot += [True] * len(own) + [False] * len(others)
            pick = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(last, pa.int32()), pa.array(key, pa.int64()), pa.array(pivot, pa.bool_())], names=["word", "n", "last", "key", "pivot"])

    keyed = stash(known.select("word", "n").mapInArrow(run, "word string, n long, last int, key long, pivot boolean"), "gram-keys")
    left = keyed.where("pivot").select("key", F.col("word").alias("w"), F.col("n").alias("n_w"), F.col("last").alias("last_w"))
    right = keyed.where("not pivot").select("key", F.col("word").alias("v"), F.col("n").alias("n_v"), F.col("last").alias("last_v"))
    close = (F.col("w") != F.col("v")) & (F.col("last_w") <= F.col("last_v")) & (F.abs(F.length("w") - F.length("v")) <= 1)
    met = left.join(right, "key").where(close).where(F.levenshtein("w", "v", 1) == 1)
    swapped = F.col("w") > F.col("v")
    pick = lambda x, y: F.when(swapped, F.col(y)).otherwise(F.col(x))
    return met.select(pick("w", "v").alias("a"), pick("n_w", "n_v").alias("n_a"), pick("v", "w").alias("b"), pick("n_v", "n_w").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (``forms``: word, form). Chains double in reach at each step.

    A form is ``times`` commoner than its word, so chains are no longer than the logarithm of the largest count.
    """
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = now.join(ahead, now["root"] == ahead["via"], "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved"))
        now = stash(moved, "roots", instead_of=now)
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs``."""
    known = stash(words(docs, p), "words")
    pairs = near(known)
    both = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")).alias("other")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("form")).alias("other")),
    ))
    best = pairs.select(both.alias("x")).groupBy("x.word").agg(F.count(F.lit(1)).alias("n_near"), F.min("x.other").alias("best"))
    common = -F.col("best.less") >= p.times * F.col("n")
    found = known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")
    )
    found = stash(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

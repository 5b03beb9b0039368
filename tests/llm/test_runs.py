"""Periodic runs against brute force over all periods, on small tables and in small tiles."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from corrob.llm import queries, runs


def runs_by_hand(words):
    """(start, length, period) of all runs, trying every period."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            stretch = words[s : i + q]
            smallest = next(p for p in range(1, q + 1) if stretch[p:] == stretch[: len(stretch) - p])
            if len(stretch) >= max(24, 3 * q) and smallest == q:
                out.append((s, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def changed(text, doc_id):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def row_by_hand(doc_id, text):
    words = changed(text, doc_id)
    found = runs_by_hand(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def repetitive(rng):
    """Words with repeats inside repeats, cut off and disturbed in places."""
    words = []
    while len(words) < rng.randrange(10, 400):
        part = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.randrange(1, 40))]
        words += (part * rng.randrange(1, 9))[: rng.randrange(1, 200)]
        if rng.random() < 0.3:
            words.append("stop")
    return words


def test_whole_documents_have_the_runs_of_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = repetitive(rng)
        found = sorted(((s, e - s + q, q) for q, s, e in runs.solve_whole(runs.numbered(words))), key=lambda r: (r[0], r[2]))
        assert found == runs_by_hand(words), words


def test_z_functions():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert runs.z_function(s) == want


def test_shorter_periods_hide_their_multiples():
    for q in (1, 2, 5, 8, 11):
        words = ["a", *(f"p{i % q}" for i in range(40 * q)), "z"]
        assert [(s, n, p) for p, s, e in runs.solve_whole(runs.numbered(words)) for n in [e - s + p]] == [(1, 40 * q, q)]


SCHEMA = "doc_id long, text string, ref string, start string, period double, runs int, words string, tile long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 0.5, 1, "c", 2) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("p", [runs.RunParams(), runs.RunParams(whole=20, tile=16), runs.RunParams(whole=0, tile=64)])
def test_digest_equals_brute_force(spark, p):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(repetitive(rng))) for i in range(60)]
    rows += [(None, "x " * 50), (None, None), (100, None), (101, ""), (102, " \n "), (103, "é x " * 30), (104, "a b c " * 8), (104, "a b c " * 8), (105, "a " * 23), (106, "a " * 24), (107, "\xa0 \x1c " * 40)]
    got = runs.digest(table(spark, rows), p)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [row_by_hand(i, t) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 20


@pytest.mark.parametrize("p", [runs.RunParams(), runs.RunParams(whole=1000, tile=2048)])
def test_very_long_texts_and_empty_tables(spark, p):
    rng = random.Random(4)
    lines = [f"u{rng.randrange(5000)}" for _ in range(20_000)]
    cycle = [f"c{i}" for i in range(9_000)]
    long_ = [*lines, *cycle, *cycle, *cycle, *cycle[:500], "end", *["same"] * 30_000]
    got = {r["doc_id"]: r for r in runs.digest(table(spark, [(1, " ".join(long_)), (2, "x" * 500_000)]), p).collect()}
    n = len(lines) + 3 * len(cycle) + 500
    assert got[1]["n_runs"] == 2 and (got[1]["start"], got[1]["length"], got[1]["period"]) == (n + 1, 30_000, 1)
    assert got[1]["runs_sha256"] == hashlib.sha256(f"{len(lines)},{n - len(lines)},9000\n{n + 1},30000,1\n".encode()).hexdigest()
    assert got[1]["collapsed_sha256"] == hashlib.sha256(" ".join([*lines, *cycle, "end", "same"]).encode()).hexdigest()
    assert got[2]["n_runs"] == 0
    assert runs.digest(table(spark, [(1, "a")]).limit(0), p).count() == 0


def test_tiles_overlap_by_what_a_block_looks_at():
    for n in (30, 1000, 5000):
        for k, s, e, first in runs.tiles(n, 64):
            block = runs.octave(k)[2]
            assert (s + first) % block == 0 and first in (0, block) and e - s <= runs.step_of(k, 64) + 4 * block
        for k in {t[0] for t in runs.tiles(n, 64)}:
            places = [c for o, s, _, first in runs.tiles(n, 64) if o == k for c in range(s + first, min(n, s + first + runs.step_of(k, 64)), runs.octave(k)[2])]
            assert places == list(range(0, n, runs.octave(k)[2]))


def test_query_equals_brute_force(spark):
    import duckdb

    rows = [r for r in duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    short = [(i, t) for i, t in rows if len((t or "").split()) < 700]
    got = {r["doc_id"]: tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows) and np.mean([got[i][1] > 0 for i, _ in rows]) > 0.05
    assert all(got[i] == row_by_hand(i, t) for i, t in short)

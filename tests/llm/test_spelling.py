"""Spelling variants against all pairs of words, on small tables."""

import random
import re
import zlib
from collections import Counter

import pytest

from corrob.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n string, form double, root int, key string, pivot int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 0.5, 1, "c", 2) for i, t in rows], SCHEMA)


def near_by_hand(a, b):
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words_by_hand(rows, letters=5, least=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= least}


def variants_by_hand(rows):
    n = words_by_hand(rows)
    shape = {}
    for w in n:  # only to make the loop shorter: near words differ by one letter at most when sorted letter by letter
        shape.setdefault(len(w), []).append(w)
    others = {w: [v for k in (-1, 0, 1) for v in shape.get(len(w) + k, ()) if near_by_hand(w, v)] for w in n}
    form = {}
    for w, near in others.items():
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def edited(rng, word, alphabet):
    at = rng.randrange(len(word) + 1)
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(alphabet) + word[at:], word[:at] + rng.choice(alphabet) + word[at + 1 :]])


@pytest.mark.parametrize("alphabet", ["ab", "abcé×ÿ", "abcdefghijklmnopqrstuvwxyz"])
def test_every_near_pair_meets(spark, alphabet):
    rng = random.Random(len(alphabet))
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 14))) for _ in range(120)]
    words = {w: rng.randrange(3, 9) for b in base for w in (b, edited(rng, b, alphabet), edited(rng, b, alphabet)) if len(w) >= 5}
    known = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted((r["a"], r["n_a"], r["b"], r["n_b"]) for r in spelling.near(known).collect())
    assert got == sorted((a, words[a], b, words[b]) for a in words for b in words if a < b and near_by_hand(a, b))


def test_words_of_four_letters_are_the_shortest(spark):
    words = ["abca", "abcb", "aaaa", "aaab", "baaa", "aaaaa", "abcda", "bcda"]
    got = {(r["a"], r["b"]) for r in spelling.near(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near_by_hand(a, b)}
    with pytest.raises(ValueError, match="four"):
        spelling.SpellingParams(letters=3)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(7)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 12)))
        kinds = sorted({word[i : i + 2] for i in range(len(word) - 1)})
        rng.shuffle(kinds)
        rank, cost = {g: i for i, g in enumerate(kinds)}, {g: rng.randrange(1, 50) for g in kinds}
        grams = spelling.prefix(word, rank)
        places = [i for i in range(len(word) - 1) if word[i : i + 2] in grams]
        assert len(places) >= 3 and len(grams) <= 3 and [rank[g] for g in grams] == list(range(len(grams)))
        pairs = [(i, j) for i in {word.find(g) for g in grams} for j in {word.rfind(g) for g in grams} if i + 2 <= j]
        first, second = spelling.pivots(word, grams, cost)
        price = lambda i, j: cost[word[i : i + 2]] + cost[word[j : j + 2]]
        assert (first, second) in pairs and price(first, second) == min(price(i, j) for i, j in pairs)


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 10))) for _ in range(60)]
    family = [w for b in base for w in (b, edited(rng, b, "abé"), edited(rng, edited(rng, b, "abé"), "abé"))]
    weights = [rng.choice([1, 2, 4, 9, 30]) for _ in family]
    sep = [" ", ", ", "1", "\n", "-", "ŁŁ"]
    rows = [(i, "".join(w.upper() + rng.choice(sep) if rng.random() < 0.2 else w + rng.choice(sep) for w in rng.choices(family, weights, k=150))) for i in range(40)]
    rows += [(None, " ".join(family)), (None, None), (41, None), (42, ""), (43, "ÀÉÎÕÜ Àéîõü àéîõü " * 3), (44, "tie " * 9), (44, "equal " * 3), (44, "equal " * 3), (45, ("y" * 5000 + " ") * 3 + ("y" * 5001 + " ") * 7)]
    got = rows_of(spelling.variants(table(spark, rows)))
    want = sorted(variants_by_hand(rows), key=lambda r: r[0])
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_chains_ties_and_empty_tables(spark):
    rows = [(1, "abcde " * 3 + "abcdef " * 6 + "abcdefg " * 12 + "abcdefgh " * 24 + "abcdx " * 6), (2, "zzzzz " * 3)]
    got = {r["word"]: r for r in spelling.variants(table(spark, rows)).collect()}
    want = {r[0]: r for r in variants_by_hand(rows)}
    assert {w: tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for w, r in got.items()} == want
    assert spelling.variants(table(spark, rows).limit(0)).count() == 0
    assert spelling.variants(table(spark, [(1, None), (2, "short")])).count() == 0


def test_very_long_texts_and_words(spark):
    rows = [(1, ("q" * 100_000 + " ") * 3), (2, "first second " * 100_000), (3, "firsts " * 3)]
    got = {r["word"][:8]: r for r in spelling.variants(table(spark, rows)).collect()}
    h = zlib.crc32(b"1:" + b"q" * 100_000)
    assert len([w for w in got if w.startswith("q")]) == 1 and got["qqqqqqqq"]["n"] == 3 and got["qqqqqqqq"]["n_near"] == 0
    assert len(got["qqqqqqqq"]["word"]) == 100_000 - (h % 97 == 0)
    assert got["first"]["n"] == 100_000 and got["firsts"]["form"] == "first" and got["firsts"]["form_n"] == 100_000


def test_query_equals_brute_force(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = rows_of(queries.op13_spelling_variants(spark, "/root/testdata/sf0.001"))
    want = sorted(variants_by_hand(rows), key=lambda r: r[0])
    assert got == want and len(want) > 500
    duckdb.sql("create or replace temp view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    said = duckdb.sql(f"select word, form, root, n, n_near, form_n from ({queries.ORACLE_SQL['op13_spelling_variants']}) order by word")
    assert said.fetchall() == got

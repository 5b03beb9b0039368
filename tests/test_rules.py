"""Rules as tables: crawl rules, phrases and patterns, names by words, hash chains; against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corrob.operators import rules as L
from corrob.operators import text as N

ROBOTS = """Disallow: /early
# a comment
User-agent: *   # all
User-Agent: Other
Disallow: /private
Allow: /private/public
Crawl-delay: 5
Disallow:
no rule
User-agent: Collector
Disallow: /c
Allow: /c
User-agent: gone
Disallow: /
"""


def robots_by_hand(text):
    groups, agents, rules = [], [], []
    for raw in text.split("\n"):
        line = re.sub("#.*", "", raw).strip()
        if ":" not in line:
            continue
        name, value = (x.strip() for x in line.split(":", 1))
        if name.lower() == "user-agent":
            if rules:
                groups.append((agents, rules))
                agents, rules = [], []
            agents.append(value.lower())
        elif name.lower() in ("allow", "disallow") and agents:
            rules.append((name.lower(), value))
    return [*groups, (agents, rules)] if agents else groups


def allowed_by_hand(text, path, agent):
    mine = [r for agents, rules in robots_by_hand(text) if any(a == "*" or a in agent.lower() for a in agents) for r in rules]
    fits = sorted((r for r in mine if r[1] and path.startswith(r[1])), key=lambda r: -len(r[1]))
    return not fits or fits[0][0] != "disallow"


def test_crawl_rules_by_agent_and_longest_path(spark):
    rng = random.Random(3)
    texts = {"h": ROBOTS, "empty": "", "none": None}
    for i in range(30):
        lines = [rng.choice(["User-agent: *", "user-agent: coll", "User-agent: x", "Allow: /a", "Disallow: /a", "Disallow: /a/b", "Allow: /a/b/c", "Disallow: /", "", "# c", "Allow:"]) for _ in range(rng.randrange(12))]
        texts[f"h{i}"] = rng.choice(["\n", "\r\n"]).join(lines)
    rules = L.robots_rules(spark.createDataFrame(list(texts.items()), "host string, text string"), "host", "text")
    paths = ["/", "/a", "/ab", "/a/b", "/a/b/c/d", "/private", "/private/x", "/private/public/y", "/c", "/early", "x", ""]
    pages = spark.createDataFrame([(h, p, i) for h in [*texts, "unknown"] for p in paths for i in (1, 2)] + [(None, "/", 3), ("h", None, 3)], "host string, path string, n int")
    for most in (0, 1000):
        got = L.decide_paths(pages, rules, "Collector/2.0", most_broadcast=most).collect()
        assert len(got) == pages.count()
        for r in got:
            want = r["host"] is None or r["path"] is None or allowed_by_hand((texts.get(r["host"]) or "").replace("\r", ""), r["path"], "Collector/2.0")
            assert r["allowed"] == want, r


def test_a_hundred_thousand_rules_are_joined_by_value(spark):
    rules = spark.range(100_000).selectExpr("concat('h', id % 10) host", "id seq", "'*' agent", "if(id % 2 = 0, 'disallow', 'allow') type", "concat('/', id div 10) path")
    pages = spark.range(1000).selectExpr("concat('h', id % 10) host", "concat('/', id div 10, '/x') path")
    out = L.decide_paths(pages, rules, "any", most_broadcast=10)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.where("allowed").count() == 500


@pytest.fixture(scope="module")
def phrase_table(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5)))
    phrases = sorted({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(12_000)})[:10_000]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(60)] + [None, "", "x" * 200_000]
    rules = [(i, p, None if i % 3 else "^" + re.escape(p)) for i, p in enumerate(phrases)]
    return rules, texts


def test_ten_thousand_phrases_in_one_pass(spark, phrase_table):
    rules, texts = phrase_table
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([*rules, (99_999, "", None), (99_998, None, "a")], "rule long, literal string, pattern string")
    got = sorted(map(tuple, L.pattern_hits(df, "id", "text", table).collect()))
    want = sorted((i, n) for i, t in enumerate(texts) if t for n, lit, pat in rules if lit in t and (pat is None or re.search(pat, t)))
    assert got == want and len(want) > 1000
    first = {r["id"]: r["rule"] for r in L.first_rule(df, "id", "text", table).collect()}
    assert first == {i: min((n for j, n in want if j == i), default=None) for i in range(len(texts))}
    assert L.pattern_hits(df, "id", "text", table.limit(0)).count() == 0 == L.pattern_hits(df.limit(0), "id", "text", table).count()
    with pytest.raises(ValueError, match="rules"):
        L.pattern_hits(df, "id", "text", table, most_rules=5)


def test_names_are_found_by_all_their_words(spark):
    df = spark.createDataFrame([(1, "Chao WEI", ["Zhao, Romans", "Wei-Chao B"]), (2, "Zhao", ["Romans Zhao"]), (3, "Wei", None), (4, None, [None, "wei chao"])], "id int, name string, aliases array<string>")
    queries = spark.createDataFrame([(1, "Wei  Chao "), (2, "Romans Zhao"), (3, "a"), (4, "wei"), (5, "chao wei b"), (6, "nobody"), (7, None), (8, "!!"), (9, "wei wei")], "q int, said string")
    got = sorted(map(tuple, L.search_names(L.name_index(df, "id", "name", "aliases"), queries, "q", "said").collect()))
    assert got == [(1, 1, None), (1, 4, "wei chao"), (2, 1, "Zhao, Romans"), (2, 2, "Romans Zhao"), (4, 1, None), (4, 3, None), (4, 4, "wei chao"), (5, 1, "Wei-Chao B"), (9, 1, None), (9, 3, None), (9, 4, "wei chao")]


def chain_of(spark, n, chains=1):
    return spark.range(n * chains).select((F.col("id") % chains).alias("c"), F.floor(F.col("id") / chains).alias("o"), F.concat(F.lit("p"), "id").alias("said"))


def test_a_chain_goes_on_and_a_tampered_record_is_named(spark):
    rows = chain_of(spark, 3000).cache()
    whole = N.hash_chain(rows, "c", "o", F.col("said"))
    first = N.hash_chain(rows.where("o < 1000"), "c", "o", F.col("said")).cache()
    more = N.hash_chain(rows.where("o >= 1000"), "c", "o", F.col("said"), N.last_hashes(first, "c", "o"))
    both = first.unionByName(more).cache()
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))
    prev = ""
    for r in both.join(rows, ["c", "o"]).orderBy("o").collect():
        assert r["previous_hash"] == prev
        prev = hashlib.sha256((prev + hashlib.sha256(r["said"].encode()).hexdigest()).encode()).hexdigest()
        assert r["hash"] == prev
    said = both.join(rows, ["c", "o"])
    check = lambda df: tuple(N.verify_chain(df, "c", "o", F.col("said")).first())
    assert check(said) == (0, 3000, 0, None)
    assert check(said.withColumn("said", F.when(F.col("o") == 1700, "other").otherwise(F.col("said")))) == (0, 3000, 1, 1700)
    assert check(said.where("o <> 1234")) == (0, 2999, 1, 1235)
    assert check(said.where("o > 0")) == (0, 2999, 1, 1)  # it began before
    forged = F.sha2(F.concat("previous_hash", F.sha2(F.lit("other"), 256)), 256)
    swapped = said.withColumn("hash", F.when(F.col("o") == 50, forged).otherwise(F.col("hash"))).withColumn("said", F.when(F.col("o") == 50, "other").otherwise(F.col("said")))
    assert check(swapped) == (0, 3000, 1, 51)  # the record agrees with itself, the next one tells
    assert check(said.withColumn("hash", F.when(F.col("o") == 9, None).otherwise(F.col("hash"))))[2:] == (2, 9)


def test_many_chains_and_none(spark):
    rows = chain_of(spark, 7, 40)
    said = N.hash_chain(rows, "c", "o", F.col("said")).join(rows, ["c", "o"])
    bad = said.withColumn("said", F.when(F.col("c") == 3, "x").otherwise(F.col("said")))
    got = {r["c"]: tuple(r)[1:] for r in N.verify_chain(bad, "c", "o", F.col("said")).collect()}
    assert got == {c: (7, 7, 0) if c == 3 else (7, 0, None) for c in range(40)}
    assert N.verify_chain(said.limit(0), "c", "o", F.col("said")).count() == 0

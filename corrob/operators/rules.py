"""Rules as tables: path rules with agents and longest prefixes, and large sets of phrases and patterns over texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast if it has ``most`` rows at most, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def robots_rules(texts: DataFrame, host: str, text: str) -> DataFrame:
    """host, seq, agent, type, path of crawl rules: one row for each agent of a group and each of the group's rules.

    Lines that name agents make a group until a rule has been said; rules before any agent and empty paths say nothing.
    Agents are lower-cased. A host has one text.
    """
    lines = texts.select(F.col(host).alias("host"), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("seq", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*", ""))).where("instr(line, ':') > 0")
    name, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.expr("substr(line, instr(line, ':') + 1)"))
    said = lines.select("host", "seq", name.alias("name"), value.alias("value")).where(F.col("name").isin("user-agent", "allow", "disallow"))
    one = Window.partitionBy("host").orderBy("seq")
    first = (F.col("name") == "user-agent") & ~F.coalesce(F.lag("name").over(one) == "user-agent", F.lit(False))
    said = said.withColumn("first", first.cast("int")).withColumn("group", F.sum("first").over(one))
    agents = said.where("name = 'user-agent'").select("host", "group", F.lower("value").alias("agent")).distinct()
    rules = said.where("name <> 'user-agent' and value <> ''").select("host", "group", "seq", F.col("name").alias("type"), F.col("value").alias("path"))
    return rules.join(agents, ["host", "group"]).select("host", "seq", "agent", "type", "path")


def decide_paths(pages: DataFrame, rules: DataFrame, agent: str, host: str = "host", path: str = "path", most_broadcast: int = 200_000) -> DataFrame:
    """``pages`` with ``allowed``: whether the longest rule whose path begins the page's, of those for the agent, allows it.

    ``rules``: host, seq, agent, type, path. A rule is for the agent if its own is ``*`` or part of the agent's name; of
    rules with one path the first counts; without a rule a page is allowed. A page's path is cut at the lengths that
    rules of its host have, and the prefixes are joined by value: no page is compared with a rule that doesn't match.
    """
    name = agent.lower()
    mine = rules.where((F.col("agent") == "*") | F.lit(name).contains(F.col("agent"))).where("path <> ''")
    known = mine.groupBy("host", F.col("path").alias("prefix")).agg(F.min_by("type", "seq").alias("type"))
    lengths = known.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # as many as a path has characters
    ask = pages.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct().join(sized(lengths, most_broadcast), "host")
    cut = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    hits = ask.select("host", "path", F.explode(cut).alias("prefix")).join(sized(known, most_broadcast), ["host", "prefix"])
    best = hits.groupBy(F.col("host").alias("__host"), F.col("path").alias("__path")).agg(F.max_by("type", F.length("prefix")).alias("__type"))
    found = pages.join(best, (F.col(host) == F.col("__host")) & (F.col(path) == F.col("__path")), "left")
    return found.withColumn("allowed", F.coalesce(F.col("__type") != "disallow", F.lit(True))).drop("__host", "__path", "__type")


def pattern_hits(df: DataFrame, key: str, text: str, rules: DataFrame, most_rules: int = 1_000_000) -> DataFrame:
    """key, rule: each rule that matches the row's text, once.

    ``rules``: rule (long), literal, pattern. A rule without pattern matches texts that have its literal; one with a
    pattern is tried only on those. All literals are looked for at once by one automaton, which is made once a
    worker, so a text is read once however many rules there are. More than ``most_rules`` rules are an error. Rules
    without a literal match nothing. Patterns are Python's.
    """
    given = rules.where("literal <> ''").select("rule", "literal", "pattern").limit(most_rules + 1).collect()
    if len(given) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in given])
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_literal: dict[str, list] = {}
        for rule, literal, pattern in shared.value:
            by_literal.setdefault(literal, []).append((rule, re.compile(pattern) if pattern else None))
        automaton = ahocorasick.Automaton()
        for literal, of in by_literal.items():
            automaton.add_word(literal, (literal, of))
        if by_literal:
            automaton.make_automaton()
        for b in batches:
            at, out = [], []
            for i, x in enumerate(b.column(1).to_pylist() if by_literal else ()):
                seen = dict(found for _, found in automaton.iter(x)) if x else {}
                hit = {rule for of in seen.values() for rule, pattern in of if pattern is None or pattern.search(x)}
                at += [i] * len(hit)
                out += sorted(hit)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.int64())], names=[key, "rule"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, rule long")


def first_rule(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """key, rule: the least rule that matches, null where none does. ``key`` is unique."""
    best = pattern_hits(df, key, text, rules).groupBy(key).agg(F.min("rule").alias("rule"))
    return df.select(key).join(best, key, "left")


def words_of(c: Column) -> Column:
    """The different words of a name, lower-cased, without punctuation."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != ""))


def name_index(entities: DataFrame, key: str, name: str, aliases: str) -> DataFrame:
    """Postings: token, key, field, text. Field 0 is the name, others are aliases by place from 1; a name's words once each."""
    names = F.concat(F.array(F.struct(F.lit(0).alias("field"), F.col(name).alias("text"))), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a, i: F.struct((i + 1).alias("field"), a.alias("text"))))
    each = entities.select(F.col(key).alias("key"), F.explode(names).alias("n")).select("key", "n.field", "n.text")
    return each.select(F.explode(words_of(F.col("text"))).alias("token"), "key", "field", "text")


def search_names(index: DataFrame, queries: DataFrame, query: str, text: str, most_broadcast: int = 200_000) -> DataFrame:
    """query, key, alias: entities whose name, or else one alias, has every word of the query, in any order; all queries at once.

    ``alias`` is the first alias that fits, null where the name does. Queries of fewer than two characters find nothing.
    Queries of the same words are one, and so are equal names: each is held against the other once, by the query's rarest
    word. What fits is joined with the entities of that name, and last with the queries of those words, so that only
    the result itself has a row for each query and entity. A query has one text.
    """
    words = F.array_sort(words_of(F.col(text)))
    asked = queries.where(F.length(F.trim(text)) >= 2).select(F.col(query).alias("query"), F.array_join(words, " ").alias("said")).where("said <> ''").distinct()
    said = asked.select("said").distinct().withColumn("words", F.split("said", " "))
    tokens = said.select("said", F.explode("words").alias("token"))
    texts = index.groupBy("token", "text").agg(F.count(F.lit(1)).alias("n"))
    often = texts.groupBy("token").agg(F.sum("n").alias("often"))
    rarest = tokens.join(often, "token", "left").groupBy("said").agg(F.min_by("token", F.struct(F.coalesce("often", F.lit(0)), "token")).alias("token"))
    found = rarest.join(texts, "token").join(said, "said")
    fits = found.where(F.size(F.array_except("words", words_of(F.col("text")))) == 0).select("said", "token", "text")
    each = index.join(sized(fits, most_broadcast), ["token", "text"])  # a name has a token once
    best = each.groupBy("said", "key").agg(F.min(F.struct("field", "text")).alias("best"))
    best = best.select("said", "key", F.when(F.col("best.field") > 0, F.col("best.text")).alias("alias"))
    return best.join(sized(asked, most_broadcast), "said").select("query", "key", "alias")

"""Quotation linking in conversations: nested quotes back to the messages they are from. DataFrame functions only.

A line's quote level is the number of ``>`` at its start. Passages of a message are all its lines of a level together,
runs of non-blank lines of one level, single lines, and sentences of runs, so a message that quotes a part, or breaks
its lines anew, links as well. They are normalised (A-Z lower-cased, other characters than letters and digits as one
space) and hashed. A quoted passage links to the latest earlier turn of its conversation that has the passage unquoted.
A message answers a turn that a passage of its least linked quote level links to: that of the longest passage, the
latest of several. Chains of answers are followed by pointer doubling, and each thread is put in order of turns, in
which answers follow what they answer. Bodies are without quotes and without the lines that announce one (``On … wrote:``).

Turns of a conversation are compared in cells of CELL turns, so a passage that many messages of one conversation share
isn't sorted in one task. Equal rows are one message. Null text counts as empty. Messages with null conv_id or turn are
threads of their own. Empty passages don't link. Very long texts are read whole. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob.llm.common import stash
from corrob.llm.urls import LOWER, UPPER

MARKS = r"^[ \t]*>[> \t]*"
#: A line that announces the quote after it, in the languages of mail programs.
ANNOUNCES = r"(?i)^\s*(?:(?:on|am|le|el|il|em|op)\b.{0,200}\b(?:wrote|schrieb\b.{0,100}|a écrit|escribió|ha scritto|escreveu|schreef\b.{0,100})|.{1,100}\b(?:wrote|writes|schrieb|a écrit|escribió))\s*:\s*$"
#: Turns that are sorted together at most within a thread.
CELL = 1024


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+", " "))


def body_of(text: Column) -> Column:
    """The text without quoted lines, lines that announce them, and blank lines at its ends."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    later = lambda k: F.slice(lines, k + 1, F.size(lines))
    quoted = lambda x: F.coalesce(x.rlike(MARKS), F.lit(False))

    def own(x: Column) -> Column:
        line, after = x["0"], F.when(F.trim(x["1"]) == "", x["2"]).otherwise(x["1"])
        return ~quoted(line) & ~(line.rlike(ANNOUNCES) & quoted(after))

    # Each line beside the two after it, so that a function over lines needn't look them up in all lines.
    kept = F.transform(F.filter(F.arrays_zip(lines, later(1), later(2)), own), lambda x: x["0"])
    return F.btrim(F.array_join(kept, "\n"), F.lit(" \t\n\x0b\f\r"))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, size, hash: the different passages of messages."""
    marks = F.regexp_extract("line", MARKS, 0)
    # What is said of a whole message is worked out before its lines are rows, not for each of them.
    parted = messages.select("conv_id", "turn", F.md5("text").alias("m"), F.split("text", "\n").alias("lines"))
    lines = parted.select("conv_id", "turn", "m", F.posexplode("lines").alias("at", "line"))
    raw = F.regexp_replace("line", MARKS, "")
    lines = lines.select("conv_id", "turn", "m", "at", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), raw.alias("raw"), normalised(raw).alias("said"))
    own = Window.partitionBy("conv_id", "turn", "m").orderBy("at")
    breaks = (F.col("said") == "") | (F.lag("said", 1, "").over(own) == "") | (F.lag("level").over(own) != F.col("level"))
    runs = lines.withColumn("run", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(own)).where("said <> ''")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]), " ")  # noqa: E731 (one message's lines)
    key = ["conv_id", "turn", "m", "level"]
    each = runs.groupBy(*key, "run").agg(joined("said").alias("said"), joined("raw").alias("raw"), F.collect_set("said").alias("lines"))
    sentences = F.transform(F.split("raw", r"(?<=[.!?。！？])\s+"), normalised)
    parts = each.select(*key, F.explode(F.array_union(F.concat(F.array("said"), "lines"), sentences)).alias("said"))
    whole = runs.groupBy(*key).agg(joined("said").alias("said"))
    all_ = parts.unionByName(whole).where("said <> ''")
    return all_.select("conv_id", "turn", "level", F.length("said").alias("size"), F.sha2("said", 256).alias("hash")).distinct()


def latest_before(found: DataFrame) -> DataFrame:
    """``found`` (conv_id, hash, turn, origin) with ``parent``: the greatest origin among rows of its passage at lower turns."""
    cell = F.floor(F.col("turn") / CELL)
    rows = found.withColumn("__cell", cell)
    inside = Window.partitionBy("conv_id", "hash", "__cell").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("__conv", "__hash").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(F.col("conv_id").alias("__conv"), F.col("hash").alias("__hash"), F.col("__cell").alias("__at")).agg(F.max("origin").alias("__last"))
    cells = cells.withColumn("__earlier", F.max("__last").over(before)).where("__earlier is not null").drop("__last")
    same = (F.col("conv_id") == F.col("__conv")) & (F.col("hash") == F.col("__hash")) & (F.col("__cell") == F.col("__at"))
    marked = rows.withColumn("__inside", F.max("origin").over(inside)).join(cells, same, "left")
    return marked.withColumn("parent", F.coalesce("__inside", "__earlier")).select(*found.columns, "parent")


def answers(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the earlier turn that each quoting turn answers."""
    known = messages.where("conv_id is not null and turn is not null")
    quoting = known.where(F.col("text").rlike("(?m)" + MARKS))
    concerned = known.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    found = passages(concerned).withColumn("origin", F.when(F.col("level") == 0, F.col("turn")))
    linked = latest_before(found).where("level > 0 and parent is not null")
    return linked.groupBy("conv_id", "turn").agg(F.max_by("parent", F.struct(-F.col("level"), "size", "parent")).alias("parent"))


def roots(parents: DataFrame) -> DataFrame:
    """conv_id, turn, parent, thread_root, depth: the chain of each answering turn, in log2(depth) joins."""
    now = stash(parents.select("conv_id", "turn", "parent", F.col("parent").alias("to"), F.lit(1).cast("long").alias("hops")), "answers")
    while True:
        step = now.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        after = now.join(step, ["conv_id", "to"], "left")
        if after.where("next is not null").isEmpty():
            return now.select("conv_id", "turn", "parent", F.col("to").alias("thread_root"), F.col("hops").alias("depth"))
        now = stash(after.select("conv_id", "turn", "parent", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "answers", instead_of=now)


def threads(conversations: DataFrame) -> DataFrame:
    """conv_id, thread_root, position, turn, role, parent_turn, depth, body: one row per message, quotes removed."""
    messages = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    chains = roots(answers(messages)).withColumnsRenamed({"conv_id": "__conv", "turn": "__turn"})
    joined = messages.join(chains, (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left")
    joined = joined.select(
        "conv_id", F.coalesce("thread_root", "turn").alias("thread_root"), "turn", "role", F.col("parent").alias("parent_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), body_of(F.col("text")).alias("body"), F.floor(F.col("turn") / CELL).alias("__cell"),
    )
    keys = ["conv_id", "thread_root", "__cell"]
    before = Window.partitionBy("conv_id", "thread_root").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "role", "body")) - 1
    numbered = joined.withColumn("__at", inside)
    right = starts.select(*(F.col(k).alias(f"__r{k}") for k in keys), "__before")
    same = [F.col(k).eqNullSafe(F.col(f"__r{k}")) for k in keys]
    placed = numbered.join(right, same)
    return placed.select("conv_id", "thread_root", (F.col("__before") + F.col("__at")).alias("position"), "turn", "role", "parent_turn", "depth", "body")


def chat_lines(threads: DataFrame) -> DataFrame:
    """conv_id, thread_root, position and ``line``: each message as a chat template takes it."""
    return threads.select("conv_id", "thread_root", "position", F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "body").alias("line"))

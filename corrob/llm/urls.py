"""URL filters: host and path rules, then a character language-model ratio. DataFrame functions only.

URLs that a rule accepts train one Markov model, those that a rule blocks another. Contexts are of variable order: up
to ORDER characters, as far back as the corpus has shown them; Witten-Bell weights mix each order with the one below,
by how often and in how many ways its context has gone on, down to a uniform guess. Characters are kept as they are, but
for A-Z in lower case. The models are tables of the character runs that occur in the URLs, so they grow with the input;
each run of ORDER + 1 characters has one log-likelihood difference, which the runs of a URL find by a join. A URL's
score is the mean difference over its characters. The threshold is the one that best separates accepted and blocked
URLs of a fold that the models have not seen, midway between the two bins it parts.

The ``most_broadcast`` commonest runs are broadcast, so that no run that every URL has is a hot key; rarer ones are
joined by shuffle. A null or malformed URL has an empty host and path and no rule; a null URL scores 0. Without
rule-matched URLs all scores and the threshold are 0 and the verdict is allow. Very long URLs are scored whole. Repeated
rows give repeated results; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of context; marks of a URL's start and end; the guess below all orders.
ORDER = 5
START, END = "\x02", "\x03"
UNIFORM = 1.0 / 256
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Scores are whole millionths per character, so sums don't depend on order; bins of calibration are hundredths.
UNIT, BIN, BINS = 1_000_000, 10_000, 2001


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the URL's or a parent domain and whose path starts the URL's; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + p), F.lit(rule)).otherwise(out)
    return out


def runs_of(symbols: Column) -> Column:
    """The runs of ORDER + 1 symbols of an array of symbols, in order."""
    out = symbols
    for k in range(1, ORDER + 1):
        out = F.zip_with(out, F.slice(symbols, k + 1, F.size(symbols)), lambda x, y: F.concat(x, y))
    return F.filter(out, lambda g: g.isNotNull())


def symbols_of(url: Column) -> Column:
    """The characters of ``url`` between marks of its start and end."""
    return F.split(F.concat(F.lit(START * ORDER), F.translate(url, UPPER, LOWER), F.lit(END)), "")


def model(counts: DataFrame) -> DataFrame:
    """run, q: the log-likelihood difference of each run's last character after the others, in millionths.

    ``counts``: run, na, nb: how often accepted and blocked URLs have it; runs that only other URLs have count zero.
    """
    below = None
    for k in range(ORDER + 1):
        # The runs of k + 1 symbols that end those of ORDER + 1, and what follows their contexts.
        t = counts.groupBy(F.right("run", F.lit(k + 1)).alias("run")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).withColumn("context", F.left("run", F.lit(k)))
        after = t.groupBy("context").agg(*(x for m in "ab" for x in (F.sum(f"n{m}").alias(f"s{m}"), F.count_if(F.col(f"n{m}") > 0).alias(f"t{m}"))))
        t = t.join(after, "context")
        t = t.withColumns({"la": F.lit(UNIFORM), "lb": F.lit(UNIFORM)}) if below is None else t.join(below, F.right("run", F.lit(k)) == F.col("tail"))
        p = lambda m: F.when(F.col(f"s{m}") > 0, (F.col(f"n{m}") + F.col(f"t{m}") * F.col(f"l{m}")) / (F.col(f"s{m}") + F.col(f"t{m}"))).otherwise(F.col(f"l{m}"))
        below = t.select(F.col("run").alias("tail"), p("a").alias("la"), p("b").alias("lb"))
    return below.select(F.col("tail").alias("run"), F.floor((F.log("la") - F.log("lb")) * UNIT + 0.5).cast("long").alias("q"))


def judge(pages: DataFrame, rules=RULES, most_broadcast: int = 50_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score (mean log-likelihood difference a character), threshold."""
    verdicts = F.create_map(*(F.lit(x) for r in rules for x in r))
    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))}).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    later = F.substring(F.md5("url"), 1, 1) < "4"
    rows = stash(read.withColumns({"known": verdicts[F.col("rule")], "later": later, "row": F.monotonically_increasing_id()}), "urls")
    runs = rows.withColumn("symbols", symbols_of(F.col("url"))).select("row", "known", "later", F.explode(runs_of(F.col("symbols"))).alias("run"))
    trains = lambda verdict: F.count_if((F.col("known") == verdict) & ~F.col("later"))
    counts = stash(runs.groupBy("run").agg(trains("allow").alias("na"), trains("block").alias("nb"), F.count(F.lit(1)).alias("n")), "runs")
    ratios = stash(model(counts).join(counts.select("run", "n"), "run"), "ratios")
    # Most runs of most URLs are among the commonest, which are no more than most_broadcast rows.
    common = F.broadcast(ratios.orderBy(F.col("n").desc(), "run").limit(most_broadcast).select("run", "q"))
    found = runs.select("row", "run").join(common, "run").select("row", "q")
    if ratios.count() > most_broadcast:
        rare = ratios.select("run", "q").join(common.select("run"), "run", "left_anti")
        found = found.unionByName(runs.select("row", "run").join(common.select("run"), "run", "left_anti").join(rare, "run").select("row", "q"))
    means = found.groupBy("row").agg((F.sum("q") / F.count(F.lit(1))).alias("mean"))
    scored = stash(rows.drop("url").join(means, "row", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0))), "scored-urls")
    bins = scored.where("known is not null and later").select((F.col("known") == "allow").alias("ok"), F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("mean") / BIN) + BINS // 2)).alias("bin"))
    bins = bins.groupBy("bin").agg(F.count_if("ok").alias("a"), F.count_if(~F.col("ok")).alias("b"))  # BINS rows at most
    ranked = bins.selectExpr(
        "bin", "coalesce((sum(a) over (order by bin rows between current row and unbounded following)) / nullif(sum(a) over (), 0), 0) "
        "+ coalesce((sum(b) over (order by bin rows between unbounded preceding and 1 preceding)) / nullif(sum(b) over (), 0), 0) as gain",
        "(bin + coalesce(lag(bin) over (order by bin), bin)) / 2 as middle",
    )
    best = ranked.agg(F.coalesce((F.max_by("middle", F.struct("gain", -F.col("bin"))) - BINS // 2) * F.lit(1.0 * BIN), F.lit(0.0)).alias("least")).scalar()
    out = scored.withColumn("least", best)
    verdict = F.coalesce("known", F.when(F.col("mean") >= F.col("least"), "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("mean") / UNIT).alias("score"), (F.col("least") / UNIT).alias("threshold"))

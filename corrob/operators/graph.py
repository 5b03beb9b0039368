"""Networks: co-occurrence, betweenness, articulation points, entity search, typed evidence graphs.

Iterated steps are joins whose results are written to the shared folder, so lineage stays short and lost executors
cost a step. Betweenness goes through the sources in batches, so that sources times nodes stay below a given number of
rows, or estimates it from a sample of sources with a bound on the error. Articulation points follow from biconnected
components, whose state is that of the nodes, their paths to the root of a breadth-first tree, and the edges.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.sources.shared import stash


def co_occurrence(df: DataFrame, array: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with entity counts, edges a < b with weights). One row's different values make its pairs."""
    values = df.select(F.array_sort(F.array_distinct(F.filter(array, lambda x: x.isNotNull()))).alias("vs"))
    nodes = values.select(F.explode("vs").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("entities"))
    first = values.where("size(vs) > 1").select(F.posexplode("vs").alias("i", "a"), "vs")
    pairs = first.select("a", F.explode(F.slice("vs", F.col("i") + 2, F.size("vs"))).alias("b"))
    return nodes, pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.where("a <> b").select("a", "b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _dependencies(e: DataFrame, sources: DataFrame) -> DataFrame:
    """node, dep: how much the shortest paths of ``sources`` (column node) depend on each node, summed over them.

    Breadth-first levels of all these sources count shortest paths, then dependencies flow back level by level.
    """
    levels = [stash(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("s", "node")
    while True:
        step = levels[-1].join(e, levels[-1]["node"] == e["a"]).groupBy("s", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        step = stash(step.join(seen, ["s", "node"], "left_anti"), "level")
        if step.isEmpty():
            break
        levels.append(step)
        # Neighbours of a level are on it, on the one before or on the next, so older ones needn't be kept in mind.
        seen = levels[-2].select("s", "node").unionByName(step.select("s", "node"))
    below, parts = levels[-1].withColumn("dep", F.lit(0.0)), []
    for depth in range(len(levels) - 1, 0, -1):
        up = levels[depth - 1].select("s", F.col("node").alias("v"), F.col("paths").alias("pv"))
        part = below.join(e, below["node"] == e["b"]).select("s", F.col("a").alias("v"), "paths", "dep").join(up, ["s", "v"])
        dep = part.groupBy("s", "v").agg(F.sum(F.col("pv") / F.col("paths") * (1 + F.col("dep"))).alias("dep"))
        parts.append(below.where("s <> node").select("node", "dep"))
        below = stash(levels[depth - 1].join(dep.withColumnRenamed("v", "node"), ["s", "node"], "left").fillna(0.0, ["dep"]), "dependencies")
    none = below.where("s <> node").select("node", "dep")
    return stash(reduce(DataFrame.unionByName, parts, none).groupBy("node").agg(F.sum("dep").alias("dep")), "dependency")


def sample_size(nodes: int, error: float, confidence: float) -> int:
    """Sources by which all normalized values are within ``error`` of the truth (times n / (n − 1)) with ``confidence``.

    Hoeffding's bound for every node at once: a source's share of a node's value lies between 0 and 1.
    """
    return min(nodes, math.ceil(math.log(2 * max(1, nodes) / (1 - confidence)) / (2 * error**2)))


def betweenness(edges: DataFrame, most_state: int = 50_000_000, error: float | None = None, confidence: float = 0.95) -> DataFrame:
    """node, betweenness (unweighted, undirected, each pair once), normalized by the pairs of other nodes.

    Sources are taken in batches of as many as keep (source, node) rows below ``most_state``. With ``error``, sources are
    a sample of ``sample_size``, drawn by hash, and values are estimates.
    """
    e = stash(both_ways(edges), "graph")
    nodes = stash(e.select(F.col("a").alias("node")).distinct(), "nodes")
    n = nodes.count()
    k = n if error is None else sample_size(n, error, confidence)
    sources = nodes if k >= n else nodes.orderBy(F.xxhash64("node"), "node").limit(k)
    batches = max(1, -(-k * n // most_state))
    sources = stash(sources.withColumn("batch", F.pmod(F.xxhash64("node", F.lit("batch")), F.lit(batches))), "sources")
    parts = [_dependencies(e, sources.where(F.col("batch") == i)) for i in range(batches)] if n else []
    none = nodes.select("node", F.lit(0.0).alias("dep"))
    total = reduce(DataFrame.unionByName, parts, none).groupBy("node").agg((F.sum("dep") * n / max(1, k) / 2).alias("betweenness"))
    return total.withColumn("normalized", F.col("betweenness") / F.lit(max(1.0, (n - 1) * (n - 2) / 2)))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the least node that each of ``nodes`` reaches over ``edges`` (a, b).

    Each node takes the least label among its neighbors', and then that label's own, until nothing changes.
    """
    e = stash(both_ways(edges), "edges")
    now = stash(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        heard = e.join(now, e["b"] == now["node"]).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("heard"))
        least = now.join(heard, now["node"] == heard["at"], "left").select("node", "label", F.least("label", "heard").alias("least"))
        via = stash(least, "least")
        jump = via.select(F.col("node").alias("at"), F.col("least").alias("further"))
        moved = via.join(jump, via["least"] == jump["at"]).select("node", F.least("least", "further").alias("label"), (F.least("least", "further") < F.col("label")).alias("moved"))
        now = stash(moved, "labels", instead_of=now)
        if now.where("moved").isEmpty():
            return now.select("node", "label")


def biconnected(edges: DataFrame) -> DataFrame:
    """node, block: the biconnected components that each node is in; a block is named by one of its nodes.

    After Tarjan and Vishkin. A breadth-first tree gives each node its path from the root; paths in their order are a
    preorder, and a path begins with those of its ancestors. Each subtree's least and greatest reach over other edges
    follow by one aggregation over the ancestors in paths. Edges of the tree, told by their lower node, are in one block
    where another edge joins their lower nodes, or where a subtree reaches out of its parent's. The state is the nodes'
    paths (as long as the tree is deep) and the edges.
    """
    e = stash(both_ways(edges), "graph")
    nodes = stash(e.select(F.col("a").alias("node")).distinct(), "nodes")
    roots = components(edges, nodes).where("node = label").select("node")
    frontier = stash(roots.select("node", F.array("node").alias("path")), "level")
    levels = [frontier]
    while True:
        step = frontier.join(e, frontier["node"] == e["a"]).groupBy(F.col("b").alias("node")).agg(F.min("path").alias("over"))
        for known in levels[-2:]:
            step = step.join(known.select("node"), "node", "left_anti")
        frontier = stash(step.select("node", F.concat("over", F.array("node")).alias("path")), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    tree = stash(reduce(DataFrame.unionByName, levels), "tree")
    parent = F.when(F.size("path") > 1, F.element_at("path", -2))
    up = tree.select(F.col("node").alias("a"), parent.alias("up_a"), F.col("path").alias("path_a"))
    to = tree.select(F.col("node").alias("b"), parent.alias("up_b"), F.col("path").alias("path_b"))
    other = e.join(up, "a").join(to, "b").where(~F.coalesce(F.col("up_a") == F.col("b"), F.lit(False)) & ~F.coalesce(F.col("up_b") == F.col("a"), F.lit(False)))
    other = stash(other.select("a", "b", "path_a", "path_b"), "other-edges")
    reach = other.select(F.col("a").alias("node"), "path_a", F.col("path_b").alias("reach")).unionByName(tree.select("node", F.col("path").alias("path_a"), F.col("path").alias("reach")))
    reach = reach.groupBy("node", F.col("path_a").alias("path")).agg(F.min("reach").alias("low"), F.max("reach").alias("high"))
    spread = reach.select(F.explode("path").alias("node"), "low", "high").groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # Lower nodes of tree edges whose upper node isn't a root, with that node's path.
    lower = tree.where("size(path) > 2").select("node", F.element_at("path", -2).alias("over"), F.expr("slice(path, 1, size(path) - 1)").alias("path")).join(spread, "node")
    within = F.slice("high", F.lit(1), F.size("path")) == F.col("path")
    out = (F.col("low") < F.col("path")) | ((F.col("high") > F.col("path")) & ~within)
    together = lower.where(out).select(F.col("node").alias("a"), F.col("over").alias("b")).unionByName(other.select("a", "b"))
    block = components(together, tree.where("size(path) > 1").select("node")).join(tree.select("node", parent.alias("over")), "node")
    return block.select(F.explode(F.array("node", "over")).alias("node"), F.col("label").alias("block")).distinct()


def articulation_points(edges: DataFrame) -> DataFrame:
    """node, articulation: whether the parts of the network grow in number when the node goes: it is in several blocks."""
    return biconnected(edges).groupBy("node").agg((F.count(F.lit(1)) > 1).alias("articulation"))


def evidence_graph(regions: DataFrame, conflicts: DataFrame, inflows: DataFrame, outflows: DataFrame, corridors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, weight; edges: a, b, relation, weight, source_name, source_url)."""
    p = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    one = F.lit(1.0)
    src = ["source_name", "source_url"]
    node = lambda df, kind, c, w: df.select(p(kind, F.col(c)).alias("id"), F.lit(kind).alias("kind"), w.cast("double").alias("weight")).where("id is not null")
    nodes = [
        node(regions, "region", "region", one), node(corridors, "corridor", "corridor", one), node(conflicts, "actor", "actor", F.col("intensity")), node(inflows, "country", "origin", F.col("qty")), node(inflows, "precursor", "product", F.col("qty")),
        *(node(df, "source", "source_name", one) for df in (conflicts, inflows, outflows)),
    ]
    known = corridors.select(F.col("corridor").alias("__c")).distinct()
    out = outflows.join(known, F.col("corridor") == F.col("__c"), "left")
    edge = lambda df, a, b, rel, w: df.select(a.alias("a"), b.alias("b"), F.lit(rel).alias("relation"), w.cast("double").alias("weight"), *src)
    said = lambda df: df.where("source_name is not null")
    conf = F.col("weighted") / 10_000 / F.col("qty")
    edges = [
        edge(conflicts, p("actor", F.col("actor")), p("region", F.col("region")), "conflict_pressure", F.col("intensity")), edge(said(conflicts), p("source", F.col("source_name")), p("actor", F.col("actor")), "reports", one),
        edge(inflows, p("country", F.col("origin")), p("region", F.col("region")), "precursor_inflow", F.col("weighted") / 10_000), edge(said(inflows), p("source", F.col("source_name")), p("country", F.col("origin")), "reports", conf),
        edge(out, p("region", F.col("region")), F.when(F.col("__c").isNotNull(), p("corridor", F.col("corridor"))).otherwise(p("region", F.col("corridor"))), "drug_outflow", F.col("qty")), edge(said(outflows), p("source", F.col("source_name")), p("region", F.col("region")), "reports", one),
    ]
    all_nodes, all_edges = nodes[0], edges[0]
    for x in nodes[1:]:
        all_nodes = all_nodes.unionByName(x)
    for x in edges[1:]:
        all_edges = all_edges.unionByName(x)
    return all_nodes.groupBy("id", "kind").agg(F.max("weight").alias("weight")), all_edges

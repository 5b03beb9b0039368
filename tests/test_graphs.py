"""Networks against plain Python: betweenness in batches and sampled, blocks and articulation points."""

import random
from collections import defaultdict, deque

import pytest

from corrob.operators import graph as G


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def neighbours(edges):
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def betweenness_by_hand(edges):
    near, total = neighbours(edges), defaultdict(float)
    for s in near:
        depth, paths, order, queue = {s: 0}, defaultdict(int, {s: 1}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        dep = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                total[w] += dep[w] / 2
    return {v: total[v] for v in near}


def parts_without(near, gone):
    seen, n = {gone}, 0
    for v in near:
        if v not in seen:
            n, queue = n + 1, [v]
            seen.add(v)
            while queue:
                for w in near[queue.pop()]:
                    if w not in seen:
                        seen.add(w)
                        queue.append(w)
    return n


def random_edges(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


CASES = {
    "one": [(1, 2)], "loop": [(1, 1), (1, 2)], "path": [(i, i + 1) for i in range(9)], "cycle": [(i, (i + 1) % 7) for i in range(7)], "star": [(0, i) for i in range(1, 8)],
    "two triangles": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)], "bridged": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (9, 8)], "repeated": [(1, 2), (2, 1), (1, 2), (2, 3)],
    "ladder": [(i, i + 2) for i in range(10)] + [(i, i + 1) for i in range(0, 12, 2)], **{f"random {k}": random_edges(random.Random(k), 16, 20) for k in range(12)},
}


def test_articulation_points_and_blocks(spark):
    """All cases side by side, as parts of one network."""
    edges = [(1000 * k + a, 1000 * k + b) for k, case in enumerate(CASES.values()) for a, b in case]
    near = neighbours(edges)
    before = parts_without(near, None)
    found = G.biconnected(frame(spark, edges)).collect()
    got = {r["node"]: r["articulation"] for r in G.articulation_points(frame(spark, edges)).collect()}
    assert got == {v: parts_without(near, v) > before for v in near}
    blocks = defaultdict(set)
    for r in found:
        blocks[r["block"]].add(r["node"])
    # Each edge lies in exactly one block; within a block no node parts the others.
    for a, b in ((a, b) for a in near for b in near[a] if a < b):
        assert sum({a, b} <= x for x in blocks.values()) == 1
    for x in blocks.values():
        inner = {v: near[v] & x for v in x}
        assert all(parts_without({w: inner[w] - {v} for w in x if w != v}, None) <= 1 for v in x)


def test_a_larger_network_keeps_a_small_state(spark):
    rng = random.Random(9)
    edges = [(i, rng.randrange(max(0, i - 400), i)) for i in range(1, 6000)] + random_edges(rng, 3000, 3000)
    edges = [(a, b) for a, b in edges if a != b]
    near, cut = neighbours(edges), set()
    low, depth = {}, {}
    for root in near:  # lowpoints, without recursion
        if root in depth:
            continue
        depth[root] = low[root] = 0
        stack, children = [(root, None, iter(near[root]))], 0
        while stack:
            v, up, it = stack[-1]
            w = next(it, None)
            if w is None:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[v])
                    if p == root:
                        children += 1
                    elif low[v] >= depth[p]:
                        cut.add(p)
            elif w not in depth:
                depth[w] = low[w] = depth[v] + 1
                stack.append((w, v, iter(near[w])))
            elif w != up:
                low[v] = min(low[v], depth[w])
        if children > 1:
            cut.add(root)
    got = {r["node"] for r in G.articulation_points(frame(spark, edges)).where("articulation").collect()}
    assert got == cut and len(cut) > 100


@pytest.mark.parametrize("most_state", [1, 100, 10**6])
def test_betweenness_in_batches(spark, most_state):
    edges = random_edges(random.Random(2), 12, 16) + [(20, 21)] if most_state > 1 else [(0, 1), (1, 2), (2, 3)]
    got = {r["node"]: r["betweenness"] for r in G.betweenness(frame(spark, edges), most_state).collect()}
    want = betweenness_by_hand(edges)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_sampled_betweenness_keeps_its_bound(spark):
    rng = random.Random(4)
    edges = [(i, rng.randrange(i)) for i in range(1, 150)] + random_edges(rng, 150, 60)
    n = len(neighbours(edges))
    error = 0.2
    assert G.sample_size(n, error, 0.95) < n and G.sample_size(10**6, 0.05, 0.9) < 4000 and G.sample_size(5, 0.01, 0.9) == 5
    want = {v: x / ((n - 1) * (n - 2) / 2) for v, x in betweenness_by_hand(edges).items()}
    got = {r["node"]: r["normalized"] for r in G.betweenness(frame(spark, edges), error=error).collect()}
    assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in want) <= error * n / (n - 1)
    assert G.betweenness(frame(spark, edges).limit(0)).count() == 0 == G.articulation_points(frame(spark, edges).limit(0)).count()

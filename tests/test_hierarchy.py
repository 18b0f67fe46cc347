import random
import time
from collections import defaultdict, deque

import pytest

from headwater.operators import graphs, local
from headwater.operators.hierarchy import Hierarchy


def brute(edges, nodes):
    kids, parents = defaultdict(set), defaultdict(set)
    for c, p in edges:
        if c and p and c != p:
            kids[p].add(c)
            parents[c].add(p)
    routes = set()
    for root in (n for n in nodes if not parents[n]):
        dist, todo = {root: 0}, deque([root])
        while todo:
            u = todo.popleft()
            for v in kids[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
        routes |= {(root, n, k) for n, k in dist.items()}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for v in kids[todo.pop()]:
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        reach[n] = seen
    cycles = set()
    for n in nodes:
        if n in reach[n]:
            comp = {m for m in reach[n] if n in reach[m]}
            cycles.add((n, min(comp), len(comp)))
    return routes, cycles


def check(spark, edges, extra=()):
    nodes = {x for e in edges for x in e if x} | set(extra)
    df = spark.createDataFrame(edges, "child string, parent string")
    h = Hierarchy(df, nodes=spark.createDataFrame([(n,) for n in nodes], "n string"))
    routes, cycles = brute(edges, nodes)
    assert {tuple(r) for r in h.routes().select("root", "node", "n_links").collect()} == routes
    assert {tuple(r) for r in h.cycles().select("node", "first", "size").collect()} == cycles
    return h


def test_random_graph_with_all_shapes(spark):
    rng = random.Random(11)
    edges = [(f"t{i:02}", f"t{rng.randint(max(0, i - 3), i - 1):02}") for i in range(1, 24)]  # a deep tree
    edges += [(f"t{rng.randint(14, 23):02}", f"t{rng.randint(0, 13):02}") for _ in range(4)]  # junctions
    edges += [("c1", "c3"), ("c2", "c1"), ("c3", "c2"), ("below", "c2")]  # a circle nothing leads into, and its tail
    edges += [("j1", "t05"), ("j1", "j4"), ("j2", "j1"), ("j3", "j2"), ("j4", "j3"), ("j5", "j3")]  # a circle below a tree
    edges += [("a", "b"), ("b", "a"), ("a", "c2"), ("self", "self"), ("x", None), (None, "y"), ("t01", "t00"), ("t01", "t00")]
    check(spark, edges, extra=["alone"])


def test_tours_and_paths(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "a")]
    h = check(spark, edges)
    assert {(r.node, r.path) for r in h.paths().collect()} == {("a", "a"), ("b", "a > b"), ("c", "a > b > c"), ("d", "a > b > d"), ("e", "a > e")}
    assert {(r.ancestor, r.node, r.distance) for r in h.descendants().collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("a", "e", 1), ("b", "c", 1), ("b", "d", 1)}


@pytest.mark.parametrize("edges", [[], [("s", "s")]])
def test_nothing_to_link(spark, edges):
    check(spark, edges)


def test_paths_and_descendants_cross_junctions_and_circles(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("f", "e"), ("f", "r2"), ("g", "f"), ("e2", "d")]  # d and f are junctions
    edges += [("p", "q"), ("q", "s"), ("s", "p"), ("t", "p"), ("f", "t")]  # a circle nothing leads into, and a junction below it
    edges += [("j", "g"), ("j", "l"), ("k", "j"), ("l", "k"), ("m", "k")]  # a circle below a tree
    h = check(spark, edges)
    paths = {(r.root, r.node): (r.n_links, r.path) for r in h.paths().collect()}
    assert paths["a", "d"] == (2, "a > b > d") and paths["a", "g"] == (5, "a > b > d > e > f > g") and paths["r2", "m"] == (5, "r2 > f > g > j > k > m")
    routes, _ = brute(edges, {x for e in edges for x in e})
    assert {(*k, n) for k, (n, _) in paths.items()} == routes and h.paths().count() == len(routes)
    up = set(edges)
    for (root, node), (n, path) in paths.items():
        names = path.split(" > ")
        assert names[0] == root and names[-1] == node and len(names) == n + 1 and all((y, x) in up for x, y in zip(names, names[1:]))
    rows = [tuple(r) for r in h.descendants().select("ancestor", "node", "distance").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == closure(edges)


def closure(edges):
    kids = defaultdict(set)
    for c, p in edges:
        kids[p].add(c)
    found = set()
    for a in {p for _, p in edges}:
        dist, todo = {}, deque([(a, 0)])
        while todo:
            u, k = todo.popleft()
            for v in kids[u] - dist.keys():
                dist[v] = k + 1
                todo.append((v, k + 1))
        found |= {(a, v, k) for v, k in dist.items()}
    return found


def test_descendants_of_random_graphs(spark):
    rng = random.Random(5)
    edges = {(f"n{i}", f"n{rng.randint(max(0, i - 4), i - 1)}") for i in range(1, 30)} | {(f"n{a}", f"n{b}") for a, b in (rng.sample(range(30), 2) for _ in range(6))}
    h = Hierarchy(spark.createDataFrame(sorted(edges), "child string, parent string"))
    assert {tuple(r) for r in h.descendants().select("ancestor", "node", "distance").collect()} == closure(edges)


def ladder(n):
    """Two nodes on each level, both below both of the level above."""
    return [(f"{side}{i:04}", f"{up}{i - 1:04}") for i in range(1, n) for side in "ab" for up in "ab"]


def test_deep_ladder_of_junctions(spark):
    n, began = 1000, time.time()
    h = Hierarchy(spark.createDataFrame(ladder(n), "child string, parent string"))
    got = {(r.root, r.node): r.n_links for r in h.routes().collect()}
    assert got == {(f"{r}0000", f"{s}{i:04}"): i for r in "ab" for s in "ab" for i in range(n) if i or r == s}
    assert h.cycles().count() == 0 and time.time() - began < 60


@pytest.mark.parametrize("edges_in_one_task", [0, 1000])
def test_both_ways_of_the_small_graph(spark, monkeypatch, edges_in_one_task):
    monkeypatch.setattr(local, "LOCAL_EDGES", edges_in_one_task)
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("f", "e"), ("f", "h"), ("g", "f"), ("h", "g"), ("h", "a"), ("i", "h"), ("i", "b"), ("s", "s2"), ("s", "t"), ("s2", "s")]
    h = check(spark, edges)
    assert h.paths().count() == h.routes().count()
    up = spark.createDataFrame([(p, c) for c, p in edges], "src string, dst string")
    got = {r.node: r.level for r in graphs.execution_levels(up).collect()}
    assert got == {"a": 0, "t": 0, "b": 1, "c": 1, "d": 2, "e": 3, **dict.fromkeys(["f", "g", "h", "i", "s", "s2"])}


def test_circles_in_one_task():
    rng = random.Random(9)
    for _ in range(60):
        pairs = [(str(rng.randint(0, 9)), str(rng.randint(0, 9))) for _ in range(rng.randint(0, 16))]
        nodes = {x for p in pairs for x in p}
        reach = {n: set() for n in nodes}
        for _ in nodes:
            for a, b in pairs:
                reach[a] |= {b} | reach[b]
        want = sorted((n, min(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes if n in reach[n])
        assert sorted(local.circles(pairs)) == want

"""Property tests: operators on random and adversarial graphs against brute-force Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict, deque

import pytest

from routegraph.operators import Edge, Graph, Not, connected_components, count_matches, find, hops_to


def make_graph(spark, n_vertices, edges, extra_vertex_ids=()):
    ids = sorted(set(range(n_vertices)) | set(extra_vertex_ids))
    v = spark.createDataFrame([(i,) for i in ids], "id bigint")
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    return Graph(v, e)


def random_edges(seed, n, m, dangling=0):
    rnd = random.Random(seed)
    out = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    out += [(rnd.randrange(n), n + 100 + i) for i in range(dangling)]  # endpoint not a vertex
    out += out[: m // 10]  # parallel edges
    return out


def bfs_to(n, edges, target):
    rev = defaultdict(set)
    for s, d in edges:
        if s != d and s < n and d < n:
            rev[d].add(s)
    dist, q = {target: 0}, deque([target])
    while q:
        u = q.popleft()
        for w in rev[u]:
            if w not in dist:
                dist[w] = dist[u] + 1
                q.append(w)
    return dist


def union_find(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, d in edges:
        if s < n and d < n:
            a, b = root(s), root(d)
            if a != b:
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(n):
        groups[root(i)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("seed,n,m", [(1, 40, 45), (2, 60, 150), (3, 30, 20)])
def test_hops_match_bfs(spark, seed, n, m):
    edges = random_edges(seed, n, m, dangling=3)
    g = make_graph(spark, n, edges)
    got = defaultdict(dict)
    for r in hops_to(g, [0, 1, 2]).collect():
        got[r["landmark"]][r["id"]] = r["hops"]
    for lm in (0, 1, 2):
        assert got[lm] == bfs_to(n, edges, lm)
    # h(src) <= h(dst) + 1 along every real edge
    for s, d in edges:
        if s < n and d < n and d in got[0]:
            assert s in got[0] and got[0][s] <= got[0][d] + 1


@pytest.mark.parametrize("seed,n,m", [(4, 50, 30), (5, 80, 70), (6, 20, 60)])
def test_components_match_union_find(spark, seed, n, m):
    edges = random_edges(seed, n, m, dangling=2)
    g = make_graph(spark, n, edges)
    got = {r["id"]: r["component"] for r in connected_components(g).collect()}
    assert got == union_find(n, edges)
    # constant along every real edge
    for s, d in edges:
        if s < n and d < n:
            assert got[s] == got[d]


def test_deep_path_graph(spark):
    """A long path with shuffled ids: many BFS levels and star rounds."""
    n = 120
    order = list(range(n))
    random.Random(7).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)]
    g = make_graph(spark, n, edges)
    h = {r["id"]: r["hops"] for r in hops_to(g, [order[-1]]).collect()}
    assert h == {order[i]: n - 1 - i for i in range(n)}
    comp = {r["component"] for r in connected_components(g).collect()}
    assert comp == {0}


def test_hub_graph_counts(spark):
    """One hub holds a third of all edges: motif counts stay exact."""
    rnd = random.Random(11)
    n = 60
    edges = [(0, rnd.randrange(1, n)) for _ in range(60)] + [
        (rnd.randrange(1, n), rnd.randrange(n)) for _ in range(120)
    ]
    g = make_graph(spark, n, edges)
    out = defaultdict(list)
    for s, d in edges:
        out[s].append(d)
    walks = Counter(c for b in out[0] for c in out[b])
    got = {r["v3"]: r["n_matches"] for r in count_matches(
        g, [Edge("v1", "v2"), Edge("v2", "v3")], keep=["v3"], seeds={"v1": [0]}).collect()}
    assert got == dict(walks)
    total = count_matches(g, [Edge("a", "b"), Edge("b", "c")], keep=[]).first()["n_matches"]
    assert total == sum(len(out.get(b, [])) for a in list(out) for b in out[a])
    per_origin = {r["a"]: r["n_matches"] for r in count_matches(
        g, [Edge("a", "b"), Edge("b", "c")], keep=["a"]).collect()}
    want = {a: sum(len(out.get(b, [])) for b in out[a]) for a in list(out)}
    assert per_origin == {a: w for a, w in want.items() if w}


@pytest.mark.parametrize("seed", [21, 22])
def test_no_return_motif_brute_force(spark, seed):
    n = 25
    edges = random_edges(seed, n, 90, dangling=2)
    g = make_graph(spark, n, edges)
    es = {(s, d) for s, d in edges if s < n and d < n}
    allset = set(edges)
    want = {
        (a, b, c)
        for (a, b) in es for (b2, c) in es
        if b2 == b and (c, a) not in allset and (b, a) not in allset
    }
    pattern = [Edge("a", "b"), Edge("b", "c"), Not(Edge("c", "a")), Not(Edge("b", "a"))]
    got = {(r["a"], r["b"], r["c"]) for r in find(g, pattern).collect()}
    assert got == want
    rows = find(g, pattern)
    assert rows.count() == len(want)  # distinct bindings under negation


def test_degree_sums(spark):
    edges = random_edges(31, 30, 80, dangling=4)
    g = make_graph(spark, 30, edges)
    d = g.degrees().agg({"inDegree": "sum", "outDegree": "sum"}).first()
    assert d[0] == d[1] == len(edges)


def test_haversine_symmetric_and_zero_on_diagonal(spark):
    from pyspark.sql import functions as F

    from routegraph.functions import haversine_km
    from routegraph.sources import tpch

    a = tpch.airports(spark, "/root/testdata/sf0.001").select("id", "latitude", "longitude")
    b = a.select(F.col("id").alias("id2"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    pairs = a.join(b, F.col("id2") == (F.col("id") * 7 + 3) % 150)
    d = pairs.select(
        haversine_km("latitude", "longitude", "lat2", "lon2").alias("ab"),
        haversine_km("lat2", "lon2", "latitude", "longitude").alias("ba"),
        haversine_km("latitude", "longitude", "latitude", "longitude").alias("aa"),
    ).collect()
    assert d and all(abs(r["ab"] - r["ba"]) < 1e-9 and r["aa"] == 0.0 for r in d)
    assert all(0.0 <= r["ab"] <= 3.1415926536 * 6371.0 + 1e-6 for r in d)

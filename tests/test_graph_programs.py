"""Message passing, PageRank, label propagation, triangles and paths against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from routegraph.operators import (
    Graph,
    Program,
    hops_by_messages,
    hops_to,
    label_propagation,
    pagerank,
    pass_messages,
    shortest_paths,
    triangle_counts,
    triangles,
)
from routegraph.operators import paths as P
from routegraph.operators.lineage import RoundTables
from routegraph.operators.triangles import oriented, wedges


def make(spark, n, edges):
    return Graph(spark.range(n).select("id"), spark.createDataFrame(edges, "src bigint, dst bigint"))


def some_edges(seed, n, m, hub=True):
    """Random edges with parallel ones, self-loops, ends that are no vertices, and a hub."""
    rng = random.Random(seed)
    out = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    out += out[: m // 4] + [(3, 3), (2, n + 5), (n + 7, 1)]
    return out + ([(i, 0) for i in range(1, n)] if hub else [])


def adjacency(n, edges):
    out = defaultdict(set)
    for a, b in edges:
        if a < n and b < n and a != b:
            out[a].add(b)
    return out


# ---- PageRank ----------------------------------------------------------------------------


def ranks(n, edges, rounds, damping=0.85):
    real = [(a, b) for a, b in edges if a < n and b < n]
    out = Counter(a for a, _ in real)
    rank, moved = {i: 1 / n for i in range(n)}, None
    for _ in range(rounds):
        lost = sum(r for i, r in rank.items() if not out[i])
        new = {i: (1 - damping) / n + damping * lost / n for i in range(n)}
        for a, b in real:
            new[b] += damping * rank[a] / out[a]
        moved = sum(abs(new[i] - rank[i]) for i in range(n))
        rank = new
    return rank, moved


@pytest.mark.parametrize("hub_edges", [1_000_000, 7])
def test_pagerank(spark, hub_edges):
    edges = some_edges(1, 40, 90)
    found = pagerank(make(spark, 40, edges), 6, hub_edges=hub_edges)
    got = {r["id"]: r["rank"] for r in found.states.collect()}
    want, moved = ranks(40, edges, 6)
    assert got == pytest.approx(want, abs=1e-12) and sum(got.values()) == pytest.approx(1)
    assert found.rounds == 6 and found.metrics["moved"] == pytest.approx(moved, abs=1e-12)


def test_pagerank_until_it_stands_still(spark):
    edges = some_edges(2, 25, 60, hub=False)
    found = pagerank(make(spark, 25, edges), rounds=None, tolerance=1e-3)
    assert 2 < found.rounds < 40 and found.metrics["moved"] <= 1e-3
    assert ranks(25, edges, found.rounds - 1)[1] > 1e-3
    with pytest.raises(ValueError):
        pagerank(make(spark, 25, edges), rounds=None)


def test_pagerank_without_edges(spark):
    g = Graph(spark.range(4).select("id"), spark.createDataFrame([], "src bigint, dst bigint"))
    assert {r["rank"] for r in pagerank(g, 3).states.collect()} == {0.25}
    empty = Graph(spark.range(0).select("id"), spark.createDataFrame([], "src bigint, dst bigint"))
    assert pagerank(empty, 3).states.collect() == []


# ---- messages ----------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [3, 4])
def test_hops_by_messages_are_hops(spark, seed):
    g = make(spark, 30, some_edges(seed, 30, 45, hub=seed == 4))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(hops_by_messages(g, 0, hub_edges=9)) == rows(hops_to(g, [0]).select("id", "landmark", "hops"))


def test_messages_with_edge_attributes(spark):
    """Widest-bottleneck values: the best least capacity of a way from vertex 0."""
    rng = random.Random(5)
    edges = [(rng.randrange(20), rng.randrange(20), rng.randrange(1, 50)) for _ in range(70)]
    table = spark.createDataFrame(edges, "src bigint, dst bigint, capacity int")
    program = Program(
        initial={"wide": F.when(F.col("id") == 0, F.lit(1000))},
        send=F.least("state.wide", "edge.capacity"),
        merge=F.max("msg"),
        update={"wide": F.greatest("wide", "msg")},
        only_changed=True,
    )
    # least() skips nulls: a state without a value must not send
    program = Program(**(vars(program) | {"send": F.when(F.col("state.wide").isNotNull(), program.send)}))
    found = pass_messages(spark.range(20).select("id"), table, program)
    want = {0: 1000}
    for _ in range(25):
        for a, b, c in edges:
            if a in want:
                want[b] = max(want.get(b, 0), min(want[a], c))
    assert {r["id"]: r["wide"] for r in found.states.collect() if r["wide"] is not None} == want
    assert found.metrics["changed"] == 0
    one = pass_messages(spark.range(20).select("id"), table, program, max_rounds=1)
    assert one.rounds == 1


def test_reserved_names_are_refused(spark):
    program = Program({"msg": F.lit(1)}, F.lit(1), F.min("msg"), {"msg": F.col("msg")})
    with pytest.raises(ValueError):
        pass_messages(spark.range(2).select("id"), spark.createDataFrame([(0, 1)], "src bigint, dst bigint"), program)


# ---- label propagation -------------------------------------------------------------------


@pytest.mark.parametrize("rounds", [1, 4])
def test_label_propagation(spark, rounds):
    n, edges = 35, some_edges(6, 35, 40)
    votes = Counter()
    for a, b in edges:
        if a < n and b < n and a != b:
            votes[a, b] += 1
            votes[b, a] += 1
    label = {i: i for i in range(n)}
    for _ in range(rounds):
        heard = defaultdict(Counter)
        for (a, b), k in votes.items():
            heard[b][label[a]] += k
        label = {i: min(heard[i], key=lambda x: (-heard[i][x], x)) if heard[i] else label[i] for i in range(n)}
    found = label_propagation(make(spark, n, edges), rounds, hub_edges=10)
    assert {r["id"]: r["label"] for r in found.states.collect()} == label


# ---- triangles ---------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [7, 8])
def test_triangles(spark, seed):
    n, edges = 30, some_edges(seed, 30, 110)
    near = defaultdict(set)
    for a, out in adjacency(n, edges).items():
        for b in out:
            near[a].add(b)
            near[b].add(a)
    want = Counter({i: 0 for i in range(n)})
    found = set()
    for a in range(n):
        for b in near[a]:
            for c in near[a] & near[b]:
                if a < b < c:
                    found.add((a, b, c))
                    want.update((a, b, c))
    g = make(spark, n, edges)
    assert {r["id"]: r["n_triangles"] for r in triangle_counts(g).collect()} == dict(want)
    rows = [tuple(sorted(r)) for r in triangles(g).collect()]
    assert set(rows) == found and len(rows) == len(found) > 5


def test_a_hub_makes_no_wedges(spark):
    """A hub of 3000 neighbours would make 4.5 million wedges if edges started at it."""
    n = 3000
    edges = [(i, 0) for i in range(1, n)] + [(i, i + 1) for i in range(1, 200)]
    g = make(spark, n, edges)
    e, _ = RoundTables(spark, "test").write(oriented(g), "e", [F.count(F.lit(1)).alias("n")])
    assert wedges(e).count() < 500
    assert e.groupBy("lo").count().agg(F.max("count")).first()[0] <= (2 * len(edges)) ** 0.5
    got = {r["id"]: r["n_triangles"] for r in triangle_counts(g).collect()}
    assert got[0] == 199 and got[1] == 1 and got[2] == 2 and got[2500] == 0


# ---- paths -------------------------------------------------------------------------------


def least_path(near, start, end):
    level, seen = [(start,)], {start}
    while level:
        done = [p for p in level if p[-1] == end]
        if done:
            return min(done)
        nxt, new = [], set()
        for p in level:
            for b in near[p[-1]]:
                if b not in seen:
                    nxt.append((*p, b))
                    new.add(b)
        seen |= new
        level = nxt
    return None


@pytest.mark.parametrize("hub_edges", [1_000_000, 8])
def test_shortest_paths_between_sets(spark, hub_edges):
    n, edges = 30, some_edges(9, 30, 50)
    near = adjacency(n, edges)
    g = make(spark, n, edges)
    for origins, ids in ((None, range(n)), ([4, 5, 99], [4, 5]), (spark.createDataFrame([(7,), (7,), (0,)], "id bigint"), [7, 0])):
        rows = shortest_paths(g, origins, [0, 6, 77], hub_edges=hub_edges).collect()
        got = defaultdict(dict)
        for r in rows:
            got[r["origin"], r["landmark"]][r["step"]] = r["id"]
        want = {(a, b): p for a in ids for b in (0, 6) if (p := least_path(near, a, b))}
        assert {k: tuple(v[i] for i in range(len(v))) for k, v in got.items()} == want
        assert len(rows) == sum(map(len, want.values()))


def test_a_deep_search_opens_a_bounded_number_of_files_per_level(spark, monkeypatch):
    n = 40
    g = make(spark, n, [(i + 1, i) for i in range(n - 1)])
    opened = []
    plain = P.new_level

    def counted(met, visited, k):
        opened.append(len(visited.t.files(visited.rel)))
        assert visited.newest is not None and len(visited.newest) <= visited.buckets
        return plain(met, visited, k)

    monkeypatch.setattr(P, "new_level", counted)
    hops = {r["id"]: r["hops"] for r in hops_to(g, [0], compact=5).collect()}
    assert hops == {i: i for i in range(n)} and len(opened) == n
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(opened) <= (5 + 1) * buckets, "not a file per level and bucket"

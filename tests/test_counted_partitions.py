"""Graph steps whose tasks hold a bounded number of rows, whatever the shuffle partitions."""

from __future__ import annotations

import contextlib
import io
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from routegraph.operators import Graph, label_propagation, pagerank, triangle_counts, triangles
from routegraph.operators.lineage import RoundTables
from routegraph.sources import tpch

N = 40


def text_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def some_edges(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(N), rng.randrange(N)) for _ in range(150)]
    return edges + edges[:30] + [(i, 0) for i in range(1, N)] + [(3, 3), (2, N + 5), (N + 7, 1), (None, 4), (4, None)]


def graph(spark, edges):
    return Graph(spark.range(N).select("id"), spark.createDataFrame(edges, "src bigint, dst bigint"))


def real(edges):
    return [(a, b) for a, b in edges if a is not None and b is not None and a < N and b < N]


@pytest.fixture
def few_rows(spark, monkeypatch):
    """Tasks of 20 rows, no broadcasts; the plans of the tables that are written."""
    from routegraph.sources import spread

    monkeypatch.setattr(spread, "ROWS_PER_TASK", 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, write = {}, RoundTables.write

    def noted(self, df, rel, metrics):
        plans[rel] = text_of(df)
        return write(self, df, rel, metrics)

    monkeypatch.setattr(RoundTables, "write", noted)
    yield plans
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_wedges_are_not_shuffled_one_by_one(spark, few_rows, monkeypatch):
    import sys

    monkeypatch.setattr(sys.modules["routegraph.operators.triangles"], "IDS_PER_TASK", 50, raising=False)
    near = defaultdict(set)
    edges = some_edges(1)
    for a, b in real(edges):
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = Counter({i: 0 for i in range(N)})
    for a in range(N):
        for b in near[a]:
            for c in near[a] & near[b]:
                if a < b < c:
                    want.update((a, b, c))
    found = triangles(graph(spark, edges))
    text = text_of(found)
    assert not re.search(r"hashpartitioning\(b#\d+L?, c#\d+L?", text), "a row for every wedge"
    assert "REPARTITION_BY_NUM" in text and "REPARTITION_BY_NUM" in few_rows["pairs"]
    assert {r["id"]: r["n_triangles"] for r in triangle_counts(graph(spark, edges)).collect()} == dict(want)


@pytest.mark.parametrize("hub_edges", [1_000_000, 10])
def test_votes_are_counted_in_bounded_tasks(spark, few_rows, hub_edges):
    edges = some_edges(2)
    votes = Counter()
    for a, b in real(edges):
        if a != b:
            votes[a, b] += 1
            votes[b, a] += 1
    label = {i: i for i in range(N)}
    for _ in range(3):
        heard = defaultdict(Counter)
        for (a, b), k in votes.items():
            heard[b][label[a]] += k
        label = {i: min(heard[i], key=lambda x: (-heard[i][x], x)) if heard[i] else label[i] for i in range(N)}
    found = label_propagation(graph(spark, edges), 3, hub_edges=hub_edges)
    assert {r["id"]: r["label"] for r in found.states.collect()} == label
    assert "REPARTITION_BY_NUM" in few_rows["pairs"] and "REPARTITION_BY_NUM" in few_rows["round=1"]


def test_shares_are_made_in_bounded_tasks(spark, few_rows):
    edges = some_edges(3)
    out = Counter(a for a, _ in real(edges))
    rank = {i: 1 / N for i in range(N)}
    for _ in range(4):
        lost = sum(r for i, r in rank.items() if not out[i])
        new = {i: (0.15 + 0.85 * lost) / N for i in range(N)}
        for a, b in real(edges):
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    got = {r["id"]: r["rank"] for r in pagerank(graph(spark, edges), 4).states.collect()}
    assert got == pytest.approx(rank, abs=1e-12)
    # pairs counted, then looked up at either end: none in the session's partitions alone
    assert few_rows["shares"].count("REPARTITION_BY_NUM") >= 3


def test_vertices_that_come_twice_double_their_edges(spark, few_rows):
    edges = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 3)] * 20
    g = Graph(spark.createDataFrame([(0,), (1,), (1,), (2,), (3,), (None,)], "id bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    pagerank(g, 1)
    label_propagation(g, 1)
    from routegraph.operators.edges import real_pairs

    t = RoundTables(spark, "test")
    try:
        got = {(r["src"], r["dst"]): r["n"] for r in real_pairs(g, t)[0].collect()}
        want = {(r["src"], r["dst"]): r["n"] for r in g.real_edges().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == want and got[0, 1] == 40 and got[2, 3] == 20
    finally:
        t.drop()


def test_many_line_items_meet_their_orders_in_bounded_tasks(spark, few_rows, tmp_path):
    spark.range(300).selectExpr("id % 90 l_orderkey", "id l_partkey", "id % 7 l_suppkey", "0.0D l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id o_orderkey", "id % 30 o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(30).selectExpr("id c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    routes = tpch.routes(spark, str(tmp_path))
    assert text_of(routes).count("REPARTITION_BY_NUM") >= 2
    want = sorted((i % 7, (i % 90) % 30, i % 30) for i in range(300))
    assert sorted(tuple(r) for r in routes.collect()) == want

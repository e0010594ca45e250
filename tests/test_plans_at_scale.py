"""Plans that only matter at scale: broadcast off, small limits, hub graphs."""

from __future__ import annotations

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from routegraph.operators import Edge, Graph, Not, connected_components, count_matches, find, hops_to
from routegraph.operators import components as C
from routegraph.operators import paths as P
from routegraph.operators.edges import SaltedEdges
from routegraph.operators.lineage import RoundTables


@pytest.fixture
def conf(spark):
    """Sets session values for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def graph(spark, edges, n):
    return Graph(
        spark.range(n).select(F.col("id")),
        spark.createDataFrame(edges, "src bigint, dst bigint"),
    )


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("by", [["dst"], ["dst", "salt"]])
@pytest.mark.parametrize("rows", [10, 100_000_000])
def test_visited_set_is_not_shuffled(spark, conf, rows, by):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = RoundTables(spark, "test")
    pairs = spark.range(500).select("id", (F.col("id") % 3).alias("landmark"))
    visited = P.BucketedTable(t, "visited", ["id", "landmark"], rows, None, 2_000_000)
    back = P.BucketedTable(t, "back", by, rows, None, 2_000_000)
    try:
        visited.append(pairs.withColumn("hops", F.lit(0)))
        edges = spark.range(500).select(F.col("id").alias("src"), (F.col("id") % 50).alias("dst"), (F.col("id") % 2).alias("salt"))
        back.append(edges.select("src", *by))
        assert visited.buckets >= int(spark.conf.get("spark.sql.shuffle.partitions"))
        front = pairs.select(F.col("id").alias("dst"), "landmark", (F.col("id") % 2).alias("salt")).select("landmark", *by)
        text = plan(P.new_level(back.table().join(front, by), visited, 1))
        assert text.count("Bucketed: true") == 2 and "Bucketed: false" not in text
        tree = text.split("\n\n\n")[0]
        # one exchange for the frontier, one for the candidates, none for the tables
        assert len(re.findall(r"[+:]- Exchange", tree)) == 2, tree
    finally:
        visited.drop()
        back.drop()
        t.drop()


def test_hops_without_broadcast_and_with_hubs(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(i, 0) for i in range(1, 60)]
    g = graph(spark, edges, 60)
    want = {}
    for start in (0, 7):
        level, seen = {start}, {start: 0}
        while level:
            level = {a for a, b in edges if b in level and a not in seen}
            seen |= {a: max(seen.values()) + 1 for a in level}
        want |= {(a, start): h for a, h in seen.items()}
    for hub_edges in (1_000_000, 10):
        got = {(r["id"], r["landmark"]): r["hops"] for r in hops_to(g, [0, 7], hub_edges=hub_edges).collect()}
        assert got == want


@pytest.mark.parametrize("hub_edges", [1_000_000, 20])
def test_a_round_of_messages_does_not_shuffle_edges(spark, conf, hub_edges):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = RoundTables(spark, "test")
    edges = spark.range(2000).select(F.col("id").alias("dst"), (F.col("id") % 40).alias("src"), F.lit(0.5).alias("share"))
    edges, m = t.write(edges, "edges", [F.count(F.lit(1)).alias("n")])
    ways = SaltedEdges(t, edges, m["n"], "src", hub_edges=hub_edges)
    try:
        assert ways.n_hubs == (40 if hub_edges == 20 else 0)
        states = spark.range(40).select(F.col("id").alias("src"), F.lit(1.0).alias("rank"))
        sent = ways.met(states).select(F.col("dst").alias("id"), (F.col("rank") * F.col("share")).alias("msg"))
        text = plan(sent)
        assert text.count("Bucketed: true") == 1
        tree = text.split("\n\n\n")[0]
        # the states and, for hubs, the join that tells their salts; the edges stay where they are
        assert len(re.findall(r"[+:]- Exchange", tree)) == (3 if ways.n_hubs else 1), tree
        assert sent.count() == 2000 and sent.agg(F.sum("msg")).first()[0] == 1000.0
    finally:
        ways.drop()
        t.drop()


def hub(spark, n):
    return spark.range(1, n).select(F.col("id").alias("x"), F.lit(0).cast("long").alias("y"))


@pytest.mark.parametrize("star", ["large", "small"])
def test_hub_is_split_in_the_star_rounds(spark, conf, star, tmp_path):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "16k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    n = 100_000
    t = RoundTables(spark, "test")
    try:
        pairs = hub(spark, n) if star == "large" else hub(spark, n).select(F.lit(n).cast("long").alias("x"), (F.col("x") - 1).alias("y"))
        e, _ = t.write(pairs.repartition(16), "e", [F.count(F.lit(1)).alias("n")])
        least = C.large_minima(e) if star == "large" else C.small_minima(e)
        least, _ = t.write(least, "least", [F.count(F.lit(1)).alias("n")])
        if star == "large":
            out = C.large_star(e, least)
        else:
            out = e.join(least, "x").filter("y != m")
        # the sums keep both columns in the shuffle, as in a round
        sums = [F.count(F.lit(1)).alias("n"), F.sum(out.columns[0]), F.sum(out.columns[1])]
        shares = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(*sums).collect()]
        assert sum(shares) == (n - 1 if star == "large" else n - 2)
        assert max(shares) < 0.4 * n, shares
    finally:
        t.drop()


def test_components_of_a_hub_graph(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    g = graph(spark, [(0, i) for i in range(1, 400)] + [(500, 501), (501, 502)], 510)
    got = {r["id"]: r["component"] for r in connected_components(g).collect()}
    assert got == {i: 0 if i < 400 else 500 if 500 <= i <= 502 else i for i in range(510)}


def test_seeded_negation_with_parallel_edges(spark):
    rng = random.Random(9)
    edges = [(0, 1)] * 300 + [(1, 2)] * 300 + [(0, 3)] * 50 + [(3, 0), (1, 4), (4, 0)]
    edges += [(rng.randrange(6), rng.randrange(6)) for _ in range(20)]
    g = graph(spark, edges, 6)
    pattern = [Edge("a", "b"), Edge("b", "c"), Not(Edge("c", "a")), Not(Edge("b", "a"))]
    df = find(g, pattern, seeds={"a": [0]})
    have = set(edges)
    want = {(0, b, c) for a, b in have if a == 0 for b2, c in have if b2 == b and (c, 0) not in have and (b, 0) not in have}
    rows = [tuple(r) for r in df.collect()]
    assert set(rows) == want and len(rows) == len(want)
    # the plan's joins see distinct pairs: no join gives more rows than there are pairs
    assert "Aggregate" in plan(df)


def test_whole_graph_walks_with_a_hub(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = [(i, 0) for i in range(1, 40)] * 3 + [(0, i) for i in range(1, 40)] + [(5, 6), (6, 99)]
    g = graph(spark, edges, 40)
    got = {r["a"]: r["n_matches"] for r in count_matches(g, [Edge("a", "b"), Edge("b", "c")], keep=["a"]).collect()}
    real = [e for e in edges if e[1] < 40]
    want = {}
    for a, b in real:
        n = sum(1 for b2, _ in real if b2 == b)
        if n:
            want[a] = want.get(a, 0) + n
    assert got == want


def test_countries_threshold_excludes(spark):
    from routegraph.plans import reports as R
    from routegraph.plans.network import Network

    rows = [(i, "n", "c", "big" if i < 7 else "small", "x" if i != 3 else None, "y", 0.0, 0.0) for i in range(10)]
    a = spark.createDataFrame(rows, "id bigint, name string, city string, country string, iata string, icao string, latitude double, longitude double")
    assert [tuple(r) for r in R.countries_over(Network(a), 3).collect()] == [("big", 6)]

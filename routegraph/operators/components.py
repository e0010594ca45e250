"""Weakly connected components by alternating large-star / small-star rounds.

Method: Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii, "Connected Components in
MapReduce and Beyond" (SoCC 2014). Edges are undirected pairs kept as (x, y) with x > y
("x points to the smaller y"). With m(u) the smallest id among u and its neighbours:

* large-star: for every neighbour v of u with v > u, emit (v, m(u));
* small-star: for every node x, let m = min of its smaller neighbours; emit (x, m) and
  (y, m) for every other smaller neighbour y of x.

Both steps keep connectivity and the pair alternates until the edge set is a forest of
stars, each centred on its component's minimum id. So the component label is the
**minimum vertex id** of the component: deterministic and comparable across engines.

Each step is one aggregation (min per node, with partial aggregation) and one equi-join on
the node id. As the rounds converge, a component's minimum neighbours every vertex of the
component, so the joins must cope with such a hub. AQE splits a skewed partition only
where a shuffle lies directly under each side of the join; the minima are an aggregate, so
they are written as a table of their own first and both sides are plain scans. Where as many
rows as there could be fit the session's broadcast budget, they are broadcast instead.
Each step is one job that writes its edge set under the checkpoint dir (lineage cut); a
round returns its fingerprint (count, hash-sum) through an Observation on the write, and
an unchanged fingerprint is then verified to be a star forest exactly (see ``lineage``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.operators.edges import fits
from routegraph.operators.graph import Graph
from routegraph.operators.lineage import RoundTables, fingerprint, row_count


# Relative error of the approximate distinct-children count observed each round (a trigger
# for the exact star-forest check only; it never decides convergence by itself).
_RSD = 0.01


def _undirected(g: Graph) -> DataFrame:
    e = g.real_edges().filter(F.col("src") != F.col("dst"))
    return e.select(
        F.greatest("src", "dst").alias("x"), F.least("src", "dst").alias("y")
    ).distinct()


def neighbours(e: DataFrame) -> DataFrame:
    return e.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(
        e.select(F.col("y").alias("u"), F.col("x").alias("v"))
    )


def large_minima(e: DataFrame) -> DataFrame:
    """(u, m): the smallest id among every node and its neighbours."""
    m = neighbours(e).groupBy("u").agg(F.min("v").alias("mv"))
    return m.select("u", F.least(F.col("u"), F.col("mv")).alias("m"))


def large_star(e: DataFrame, minima: DataFrame) -> DataFrame:
    # No distinct here: small-star only takes minima and ends with its own distinct,
    # so duplicate (v, m) pairs cost nothing but save one exchange per round.
    return neighbours(e).filter(F.col("v") > F.col("u")).join(minima, "u").select(
        F.col("v").alias("x"), F.col("m").alias("y")
    )


def small_minima(e: DataFrame) -> DataFrame:
    """(x, m): every node's smallest smaller neighbour."""
    return e.groupBy("x").agg(F.min("y").alias("m"))


def small_star(e: DataFrame, minima: DataFrame) -> DataFrame:
    to_min = e.join(minima, "x").filter(F.col("y") != F.col("m")).select(
        F.col("y").alias("x"), F.col("m").alias("y")
    )
    return to_min.unionByName(minima.select("x", F.col("m").alias("y"))).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """Every child has exactly one parent and no parent is itself a child (one job)."""
    ends = e.select(
        F.inline(
            F.array(
                F.struct(F.col("x").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
                F.struct(F.col("y").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")),
            )
        )
    )
    per = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    return per.filter((F.col("c") > 1) | ((F.col("c") > 0) & (F.col("p") > 0))).isEmpty()


def star_forest(edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """(child x, centre y) pairs of the converged star forest, and the round count.

    ``edges`` are distinct pairs x > y. Without ``max_rounds`` the rounds run until they
    converge; with it, a run that needs more raises ``RuntimeError``.
    """
    t = RoundTables(edges.sparkSession, "components")
    metrics = [*fingerprint("x", "y"), F.approx_count_distinct("x", _RSD).alias("children")]
    kept: list[str] = []

    def write(df: DataFrame, rel: str, what=None) -> tuple[DataFrame, dict]:
        kept.append(rel)
        return t.write(df, rel, what or row_count())

    def minima(df: DataFrame, rel: str, most: int) -> DataFrame:
        """The minima, of which there are no more than ``most``."""
        return F.broadcast(df) if fits(t.spark, most) else write(df, rel)[0]

    def forget(but: str) -> None:
        for rel in [r for r in kept if r != but]:
            t.delete(rel)
            kept.remove(rel)

    try:
        e, fp = write(edges, "round=0", metrics)
        rnd = 0
        while max_rounds is None or rnd < max_rounds:
            rnd += 1
            least = minima(large_minima(e), f"large-minima={rnd}", 2 * fp["n"])
            large, m = write(large_star(e, least), f"large={rnd}")
            least = minima(small_minima(large), f"small-minima={rnd}", m["n"])
            nxt, cur = write(small_star(large, least), f"round={rnd}", metrics)
            forget(f"round={rnd}")  # nothing reads the others any more
            unchanged = (cur["n"], cur["h"]) == (fp["n"], fp["h"])
            # A star forest has one edge per child. When the (approximate) number of distinct
            # children is that close to the edge count, try the exact check one round early.
            one_parent_each = cur["children"] >= (1 - 3 * _RSD) * cur["n"]
            if (unchanged or one_parent_each) and _is_star_forest(nxt):
                t.drop_at_exit()
                return nxt, rnd
            e, fp = nxt, cur
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    except BaseException:
        t.drop()
        raise


def connected_components(g: Graph, max_rounds: int | None = None) -> DataFrame:
    """(id, component) for every vertex; component = smallest id in its weak component.

    A vertex without edges to other vertices (isolated, or only self-loops / dangling
    edges) is its own component.
    """
    stars, _ = star_forest(_undirected(g), max_rounds)
    return (
        g.vertex_ids()
        .join(stars.select(F.col("x").alias("id"), F.col("y").alias("component")), "id", "left")
        .select("id", F.coalesce(F.col("component"), F.col("id")).alias("component"))
    )


def components_of_pairs(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component) of the vertices that occur in ``pairs`` (src, dst).

    The distinct pairs are written once and serve both the rounds and the final choice of
    ids, so the edges are derived a single time.
    """
    t = RoundTables(pairs.sparkSession, "pairs")
    try:
        edges, _ = t.write(pairs.select("src", "dst").distinct(), "pairs", row_count())
        g = Graph(vertices.select("id"), edges)
        found = connected_components(g).join(g.endpoint_ids(), "id", "left_semi")
    except BaseException:
        t.drop()
        raise
    t.drop_at_exit()
    return found


def component_sizes(components: DataFrame, min_size: int = 1) -> DataFrame:
    """(component, size) for components with at least ``min_size`` vertices."""
    return (
        components.groupBy("component")
        .agg(F.count(F.lit(1)).alias("size"))
        .filter(F.col("size") >= min_size)
    )

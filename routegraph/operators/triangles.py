"""Triangle counts over edges oriented from the smaller to the larger degree.

A triangle is three vertices each two of which are joined by an edge, in any direction and
however often. Every pair of joined vertices becomes one edge from the vertex of smaller
degree (ties: smaller id) to the other. Then no vertex has more than sqrt(2 * pairs) edges
out, whatever its degree: a hub that all others point to starts no wedge at all. A triangle is
found once, at its first vertex: two edges out of it, closed by an edge between their ends.

The ends of a vertex's edges are one list in the order of (degree, id), at most sqrt(2 * pairs)
long. All wedges of a first edge go to its end as one row with the rest of the list, and those
closed are what the rest shares with the end's own list: a row is shuffled and sorted for every
edge, not for every wedge. The rows that meet at a hub carry only ends of still larger degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.operators.edges import looked_up, real_pairs, symmetric
from routegraph.operators.graph import Graph
from routegraph.operators.lineage import RoundTables, row_count
from routegraph.sources.spread import spread

#: Ids in the lists a task sorts at most (8 bytes each).
IDS_PER_TASK = 8_000_000


def oriented(g: Graph) -> DataFrame:
    """(lo, hi, hi_degree): one row per joined pair, from the smaller (degree, id) on."""
    t = RoundTables(g.vertices.sparkSession, "pairs")
    try:
        pairs, _ = real_pairs(g, t, undirected=True)
        pairs, m = t.write(pairs.select("src", "dst"), "pairs", row_count())
        t.delete("ends")
        t.delete("ids")
        degrees, v = t.write(
            symmetric(pairs).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("value")), "degrees", row_count()
        )
        both = pairs
        for end in ("src", "dst"):
            both = looked_up(both, m["n"], degrees, v["n"], end, f"{end}_n")
        t.drop_at_exit()
    except BaseException:
        t.drop()
        raise
    forward = F.struct("src_n", "src") < F.struct("dst_n", "dst")
    return both.select(
        F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("lo"),
        F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("hi"),
        F.greatest("src_n", "dst_n").alias("hi_degree"),
    )


def end_lists(edges: DataFrame) -> DataFrame:
    """(lo, ends): the ends of a vertex's edges in the order of (degree, id)."""
    ends = F.sort_array(F.collect_list(F.struct("hi_degree", "hi")))
    return edges.groupBy("lo").agg(F.transform(ends, lambda e: e["hi"]).alias("ends"))


def wedge_lists(lists: DataFrame) -> DataFrame:
    """(a, b, cs): an edge out of ``a`` and the ends after ``b`` in the list of ``a``."""
    each = lists.select(F.col("lo").alias("a"), "ends", F.posexplode("ends").alias("i", "b"))
    rest = F.slice("ends", F.col("i") + 2, F.size("ends"))
    return each.filter(F.col("i") + 1 < F.size("ends")).select("a", "b", rest.alias("cs"))


def wedges(edges: DataFrame) -> DataFrame:
    """(a, b, c): pairs of edges out of ``a``, ``b`` before ``c`` in the order of (degree, id)."""
    return wedge_lists(end_lists(edges)).select("a", "b", F.explode("cs").alias("c"))


def triangles(g: Graph) -> DataFrame:
    """(a, b, c): every triangle once, its vertices in the order of (degree, id)."""
    t = RoundTables(g.vertices.sparkSession, "triangles")
    try:
        edges, m = t.write(oriented(g), "oriented", row_count())
        n = F.size("ends").cast("bigint")
        lists, seen = t.write(
            end_lists(spread(edges, m["n"], "lo")), "lists", [F.sum(n * (n - 1) / 2).cast("bigint").alias("wedges")]
        )
        t.delete("oriented")
    except BaseException:
        t.drop()
        raise
    t.drop_at_exit()
    rest = spread(wedge_lists(lists), seen["wedges"] or 0, "b", per_task=IDS_PER_TASK)
    # packed lists are small files but large rows: they must not be taken for a table to broadcast
    met = rest.join(lists.select(F.col("lo").alias("b"), "ends").hint("merge"), "b")
    return met.select("a", "b", F.explode(F.array_intersect("cs", "ends")).alias("c"))


def triangle_counts(g: Graph) -> DataFrame:
    """(id, n_triangles) for every vertex."""
    per_vertex = triangles(g).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_triangles")
    )
    return g.vertex_ids().join(per_vertex, "id", "left").select(
        "id", F.coalesce("n_triangles", F.lit(0)).cast("bigint").alias("n_triangles")
    )

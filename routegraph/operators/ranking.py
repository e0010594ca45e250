"""PageRank and label propagation as vertex programs (see ``messages``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routegraph.operators.edges import HUB_EDGES, fits, real_pairs, symmetric
from routegraph.operators.graph import Graph
from routegraph.operators.lineage import RoundTables, row_count
from routegraph.operators.messages import Program, Rounds, pass_messages
from routegraph.sources.spread import spread


def pagerank(
    g: Graph, rounds: int | None = 20, tolerance: float | None = None, damping: float = 0.85, **options
) -> Rounds:
    """(id, rank) for every vertex; ranks add up to 1.

    A vertex shares its rank among its edges, parallel ones counted; self-loops count, edges
    to what is no vertex do not. The rank of vertices without edges out (dangling mass) goes to
    all alike. It stops after ``rounds`` rounds, or once the ranks together moved by no more
    than ``tolerance``; both the mass and the movement are metrics of the round's own write,
    so a round is one job and no rank reaches the driver.

    Parallel edges are counted to one weighted edge first, in tasks of bounded rows; a hub's rank is sent along buckets
    of its edges, and what a hub receives is summed before the shuffle.
    """
    if rounds is None and tolerance is None:
        raise ValueError("give a number of rounds, a tolerance, or both")
    t = RoundTables(g.vertices.sparkSession, "pagerank")
    try:
        pairs, n_edges = real_pairs(g, t)
        out = F.sum("n").over(Window.partitionBy("src"))
        by_src = spread(pairs, n_edges, "src").select("src", "dst", (F.col("n") / out).alias("share"))
        shares, _ = t.write(by_src, "shares", row_count())
        t.delete("ends")
        t.delete("ids")
        senders = shares.select(F.col("src").alias("id"), F.lit(False).alias("dangling")).distinct()
        vertices, m = t.write(
            g.vertex_ids().join(senders, "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")),
            "vertices", row_count(),
        )
        n = max(m["n"], 1)

        def update(seen: dict) -> dict:
            base = (1 - damping) / n + damping * (seen["lost"] or 0.0) / n
            return {
                "rank": F.lit(base) + damping * F.coalesce("msg", F.lit(0.0)),
                "dangling": F.col("dangling"),
            }

        program = Program(
            initial={"rank": F.lit(1.0 / n), "dangling": F.col("dangling")},
            send=F.col("state.rank") * F.col("edge.share"),
            merge=F.sum("msg"),
            update=update,
            observe={
                "lost": F.sum(F.when(F.col("dangling"), F.col("rank"))),
                "moved": F.sum(F.abs(F.col("rank") - F.col("old.rank"))),
            },
        )
        done = None if tolerance is None else (lambda seen: (seen["moved"] or 0.0) <= tolerance)
        found = pass_messages(vertices, shares, program, rounds, done, **options)
        return Rounds(found.states.select("id", "rank"), found.rounds, found.metrics)
    finally:
        t.drop()


def label_propagation(g: Graph, rounds: int, **options) -> Rounds:
    """(id, label): each round, every vertex takes the label most of its neighbours hold.

    Neighbours count once for each edge that joins them, in either direction; self-loops do
    not count. Ties go to the smallest label, so labels are the same on every run; a vertex
    without neighbours keeps its id. All vertices change at once; two that swap labels for
    ever do so until ``rounds`` ends.

    The most frequent label is found in two steps, counts per (vertex, label), then the best
    count per vertex, in tasks of bounded rows. The votes of a vertex with more than
    ``hub_edges`` neighbours are dealt by label to several, so they never meet in one task.
    """
    t = RoundTables(g.vertices.sparkSession, "labels")
    try:
        pairs, _ = real_pairs(g, t, undirected=True)
        pairs, m = t.write(pairs, "pairs", row_count())
        t.delete("ends")
        t.delete("ids")
        both, n_votes = symmetric(pairs, "n"), 2 * m["n"]
        limit = options.get("hub_edges", HUB_EDGES)
        degrees = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
        hubs, h = t.write(degrees.select("id", F.ceil(F.col("n") / limit).cast("int").alias("salts")), "hubs", row_count())

        def most_frequent(sent: DataFrame) -> DataFrame:
            votes, salts = sent.select("id", "msg.label", "msg.n"), F.lit(1)
            if h["n"]:
                told = F.broadcast(hubs) if fits(sent.sparkSession, h["n"]) else hubs
                votes, salts = votes.join(told, "id", "left"), F.coalesce("salts", F.lit(1))
            votes = votes.select("id", F.pmod(F.xxhash64("label"), salts).cast("int").alias("salt"), "label", "n")
            votes = spread(votes, n_votes, "id", "salt").groupBy("id", "salt", "label").agg(F.sum("n").alias("n"))
            best = F.min(F.struct(-F.col("n"), F.col("label"))).alias("best")
            best = votes.groupBy("id", "salt").agg(best).groupBy("id").agg(F.min("best").alias("best"))
            return best.select("id", F.col("best.label").alias("msg"))

        program = Program(
            initial={"label": F.col("id")},
            send=F.struct(F.col("state.label").alias("label"), F.col("edge.n").alias("n")),
            merge=most_frequent,
            update={"label": F.coalesce("msg", "label")},
        )
        return pass_messages(g.vertex_ids(), both, program, rounds, **options)
    finally:
        t.drop()

"""Unweighted shortest paths (hop counts) from every vertex to a set of landmarks.

Semantics follow the usual graph-library ``shortestPaths(landmarks)``: the number of
edges on a shortest directed path *from* a vertex *to* the landmark; the landmark is 0
from itself; an unreachable pair has no entry. Only edges between real vertices count.

Algorithm: one breadth-first search per landmark, all landmarks at once, walking edges
backwards (dst -> src). State is long format ``(id, landmark, hops)``; each round expands
only the previous round's frontier, so total join work is O(|E| x |landmarks|) across
all rounds, not per round.

Per round:
* the frontier (the files of the last append; (id, landmark) rows) joins the distinct reverse
  edges on ``dst = id``. When its exact row count, known from the previous round, fits the
  session broadcast budget it is broadcast. Otherwise only the frontier is shuffled: the
  edges are bucketed by ``dst``, hubs over several buckets (see ``edges.SaltedEdges``).
* candidates are shuffled once, into the buckets of the visited set, aggregated there (the
  least next vertex on the way to the landmark) and anti-joined with it. The visited set is
  one table bucketed by (id, landmark) and is not shuffled. Spark reads a table by buckets
  only if it has at least as many of them as the session's shuffle partitions, so there are
  never fewer; more follow the state's size.
* the new level is appended to that table under the checkpoint dir (see ``lineage``): one
  job per level, lineage cut at every level, and the level's row count comes back through
  an Observation on that write. Every ``COMPACT`` levels the table is written anew with one
  file per bucket, so that a level opens a bounded number of files. The result is the table.

The loop ends on an empty frontier (or ``max_hops``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.operators.edges import HUB_EDGES, ROWS_PER_BUCKET, BucketedTable, SaltedEdges
from routegraph.operators.graph import Graph
from routegraph.operators.lineage import RoundTables, row_count

#: Levels after which the visited table is written anew.
COMPACT = 8
_STATE = "id bigint, landmark bigint, hops int, via bigint"


def _landmark_ids(g: Graph, landmarks) -> DataFrame:
    v = g.vertex_ids()
    if isinstance(landmarks, DataFrame):
        return v.join(landmarks.select("id").distinct(), "id", "left_semi")
    return v.filter(F.col("id").isin(list(landmarks)))


def hops_to(
    g: Graph, landmarks, max_hops: int | None = None, *, database: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET, hub_edges: int = HUB_EDGES, compact: int = COMPACT,
) -> DataFrame:
    """(id, landmark, hops) for every vertex that can reach a landmark; hops is int.

    ``landmarks`` are ids or a DataFrame with an ``id`` column."""
    found = search(
        g, landmarks, max_hops, database=database, rows_per_bucket=rows_per_bucket, hub_edges=hub_edges, compact=compact
    )
    return found.select("id", "landmark", "hops")


def search(
    g: Graph, landmarks, max_hops: int | None = None, *, database: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET, hub_edges: int = HUB_EDGES, compact: int = COMPACT,
) -> DataFrame:
    """(id, landmark, hops, via): also the least next vertex on a shortest way (null at the end)."""
    if not isinstance(landmarks, DataFrame):
        landmarks = list(landmarks)  # ids; any iterable
    t = RoundTables(g.vertices.sparkSession, "hops")
    # Only the source needs the vertex check: the frontier only ever holds real vertices
    # (landmarks are filtered to vertices, later levels are checked sources), so an edge
    # whose destination is not a vertex can never be reached from it.
    edges = g.edges.select("src", "dst").filter(F.col("src") != F.col("dst"))
    back = visited = None
    try:
        rev, m = t.write(
            edges.join(g.id_lookup().withColumnRenamed("id", "src"), "src").distinct(), "edges",
            [*row_count(), F.approx_count_distinct("src").alias("sources")],
        )
        start = _landmark_ids(g, landmarks).select(
            "id", F.col("id").alias("landmark"), F.lit(0).alias("hops"), F.lit(None).cast("bigint").alias("via")
        )
        n_landmarks = len(landmarks) if not isinstance(landmarks, DataFrame) else start.count()
        back = SaltedEdges(t, rev, m["n"], "dst", "edges_by_dst", database, rows_per_bucket, hub_edges)
        # every visited (id, landmark) has id = a landmark or the source of an edge
        visited = BucketedTable(
            t, "visited", ["id", "landmark"], (m["sources"] + n_landmarks) * n_landmarks, database, rows_per_bucket
        )
        n_level, k = visited.append(start), 0
        while n_level > 0 and (max_hops is None or k < max_hops):
            front = visited.appended(_STATE)
            if front is None:  # no listing of files here: Parquet statistics prune other levels
                front = visited.table().filter(F.col("hops") == k)
            front = front.select(F.col("id").alias("dst"), "landmark")
            k += 1
            level = new_level(back.met(front, n_level), visited, k)
            if visited.appends >= compact:
                level, _ = t.write(level, f"level={k}", row_count())
                visited = visited.compacted()
                n_level = visited.append(level)
                t.delete(f"level={k}")
            else:
                n_level = visited.append(level, arranged=True)
        result = visited.files(_STATE)
        t.drop_at_exit()
        return result
    except BaseException:
        t.drop()
        raise
    finally:
        if visited is not None:
            visited.drop()
        if back is not None:
            back.drop()
        t.delete("edges")


def new_level(met: DataFrame, visited: BucketedTable, k: int) -> DataFrame:
    """(id, landmark, hops = k, via): sources of edges into the frontier that were not visited.

    ``met``: the edges (src, dst) that meet the frontier, with its landmarks. The least
    ``dst`` is found by the aggregation that keeps one row per (id, landmark)."""
    reached = met.select(F.col("src").alias("id"), "landmark", "dst")
    cand = reached.repartition(visited.buckets, "id", "landmark").groupBy("id", "landmark").agg(F.min("dst").alias("via"))
    seen = visited.table().select("id", "landmark")
    return cand.join(seen, ["id", "landmark"], "left_anti").select(
        "id", "landmark", F.lit(k).cast("int").alias("hops"), "via"
    )


def shortest_paths(g: Graph, origins, landmarks, max_hops: int | None = None, **options) -> DataFrame:
    """(origin, landmark, step, id): the vertices of one shortest path for every pair.

    Of several shortest paths it is the least by the ids along it. ``origins`` are ids, a
    DataFrame with an ``id`` column, or None for all vertices. A pair without a path has no
    rows; a landmark that is its own origin has step 0 alone.

    The search leaves the next vertex towards each landmark; paths are rebuilt by following
    it, all pairs at once and a step per round, so no path is collected while it grows.
    """
    towards = search(g, landmarks, max_hops, **options)
    t = RoundTables(g.vertices.sparkSession, "paths")
    try:
        at = towards.select(F.col("id").alias("origin"), "landmark", "id", "hops", "via")
        if origins is not None:
            wanted = origins if isinstance(origins, DataFrame) else None
            if wanted is None:
                at = at.filter(F.col("origin").isin(list(origins)))
            else:
                at = at.join(wanted.select(F.col("id").alias("origin")).distinct(), "origin", "left_semi")
        step, m = t.write(at, "step=0", [F.max("hops").alias("longest")])
        steps = [step]
        ahead = towards.select("id", "landmark", "hops", "via")
        for k in range(1, (m["longest"] or 0) + 1):
            on = steps[-1].filter("via IS NOT NULL").select("origin", "landmark", F.col("via").alias("id"))
            step, _ = t.write(
                on.join(ahead, ["id", "landmark"]).select("origin", "landmark", "id", "hops", "via"), f"step={k}", row_count()
            )
            steps.append(step)
        # one scan of all steps: the folder names them
        schema = "origin bigint, landmark bigint, id bigint, hops int, via bigint, step int"
        t.drop_at_exit()
        return t.spark.read.schema(schema).parquet(t.root).select("origin", "landmark", "step", "id")
    except BaseException:
        t.drop()
        raise


def hops_map(g: Graph, hops: DataFrame) -> DataFrame:
    """Vertices plus ``distances``: map landmark id -> hops (empty map when none is reachable).

    Each vertex collects at most one entry per landmark, so the group size is bounded by the
    landmark count the caller chose.
    """
    per_vertex = hops.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("landmark", "hops"))).alias("distances")
    )
    empty = F.create_map().cast("map<bigint,int>")
    return g.vertices.join(per_vertex, "id", "left").withColumn(
        "distances", F.coalesce(F.col("distances"), empty)
    )


def hops_pair(hops: DataFrame, a: int, b: int) -> DataFrame:
    """(id, hops_to_a, hops_to_b) for vertices that reach both landmarks (one pivot, no self-join)."""
    wide = hops.filter(F.col("landmark").isin([a, b])).groupBy("id").agg(
        F.min(F.when(F.col("landmark") == a, F.col("hops"))).alias("hops_to_a"),
        F.min(F.when(F.col("landmark") == b, F.col("hops"))).alias("hops_to_b"),
    )
    return wide.filter(F.col("hops_to_a").isNotNull() & F.col("hops_to_b").isNotNull())


def hops_compare(hops: DataFrame, a: int, b: int) -> DataFrame:
    """One row: how many vertices are nearer (in hops) to a, nearer to b, or equally near."""
    p = hops_pair(hops, a, b)
    return p.agg(
        F.count_if(F.col("hops_to_a") < F.col("hops_to_b")).alias("n_closer_to_a"),
        F.count_if(F.col("hops_to_a") > F.col("hops_to_b")).alias("n_closer_to_b"),
        F.count_if(F.col("hops_to_a") == F.col("hops_to_b")).alias("n_equal"),
    )

"""Property graph over two DataFrames, and its relational operators.

A ``Graph`` is a directed multigraph: ``vertices`` has a unique ``id`` column plus
attributes, ``edges`` has ``src``/``dst`` plus attributes (one row per edge, parallel
edges and self-loops are real). Edge endpoints are *not* validated against the vertex
set: degree operators count raw edge rows, while motifs, hops and components only
use edges whose two endpoints are vertices ("real" edges).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def __post_init__(self) -> None:
        vtypes = dict((f.name, f.dataType) for f in self.vertices.schema.fields)
        etypes = dict((f.name, f.dataType) for f in self.edges.schema.fields)
        if "id" not in vtypes:
            raise ValueError(f"vertices need an 'id' column; got {sorted(vtypes)}")
        for c in ("src", "dst"):
            if c not in etypes:
                raise ValueError(f"edges need '{c}'; got {sorted(etypes)}")
        for name, t in (("id", vtypes["id"]), ("src", etypes["src"]), ("dst", etypes["dst"])):
            if not isinstance(t, IntegralType):
                raise TypeError(f"column {name!r} must be an integral id type, got {t.simpleString()}")

    # ---------------------------------------------------------------- accessors
    def vertex_ids(self) -> DataFrame:
        return self.vertices.select("id")

    def id_lookup(self) -> DataFrame:
        """Vertex ids for existence joins. No static broadcast: the vertex table can be as
        large as the edge table, and counting it first would cost a scan per query; AQE
        turns the join into a broadcast at runtime when the measured side is small."""
        return self.vertex_ids()

    def vertex_table(self, *cols: str) -> DataFrame:
        """Vertex attributes for joins (same reasoning as ``id_lookup``)."""
        return self.vertices.select(*cols)

    def out_degrees(self) -> DataFrame:
        """(id, outDegree): edge rows per source, parallel/self-loop/dangling edges counted."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outDegree"))

    def in_degrees(self) -> DataFrame:
        """(id, inDegree): edge rows per destination."""
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("inDegree"))

    def degrees(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, inDegree, outDegree) in ONE pass over the edges (one shuffle, not two plus a join).

        Each edge row emits (src, out=1) and (dst, in=1); partial aggregation collapses a hub
        before the shuffle, so a hot airport costs one row per map task. With ``ids`` (a
        DataFrame with an ``id`` column) only those are counted: the other edge ends go
        before the aggregation.
        """
        ends = self.edges.select(
            F.inline(
                F.array(
                    F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                    F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                )
            )
        )
        if ids is not None:
            ends = ends.join(ids.select("id"), "id", "left_semi")
        return ends.groupBy("id").agg(
            F.sum("i").cast("bigint").alias("inDegree"), F.sum("o").cast("bigint").alias("outDegree")
        )

    def real_edges(self) -> DataFrame:
        """Edges whose two endpoints are vertices (ids are unique, so inner joins never multiply)."""
        v = self.id_lookup()
        return self.edges.join(v.withColumnRenamed("id", "src"), "src").join(
            v.withColumnRenamed("id", "dst"), "dst"
        ).select(*self.edges.columns)

    def endpoint_ids(self) -> DataFrame:
        """Distinct ids that occur as an edge endpoint (a self-loop counts)."""
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    # ---------------------------------------------------------------- subgraphs
    def drop_isolated_vertices(self) -> "Graph":
        """Keep vertices that appear as src or dst of some edge; edges unchanged."""
        return Graph(self.vertices.join(self.endpoint_ids(), "id", "left_semi"), self.edges)

    def filter_edges(self, condition: Column | str) -> "Graph":
        return Graph(self.vertices, self.edges.filter(condition))

    def subgraph(self, edge_condition: Column | str) -> "Graph":
        """Edge-filtered subgraph with the vertices that no longer touch an edge removed."""
        return self.filter_edges(edge_condition).drop_isolated_vertices()

    # ------------------------------------------------------ algorithm shortcuts
    def find(self, pattern, seeds=None):
        from routegraph.operators.motif import find

        return find(self, pattern, seeds)

    def count_matches(self, pattern, keep, seeds=None):
        from routegraph.operators.motif import count_matches

        return count_matches(self, pattern, keep, seeds)

    def hops_to(self, landmarks, max_hops=None):
        from routegraph.operators.paths import hops_to

        return hops_to(self, landmarks, max_hops)

    def connected_components(self):
        from routegraph.operators.components import connected_components

        return connected_components(self)

    # ------------------------------------------- graph-library style aliases
    # Fixed names of the public graph-library API, with its result shapes.
    @property
    def outDegrees(self) -> DataFrame:  # noqa: N802
        return self.out_degrees()

    @property
    def inDegrees(self) -> DataFrame:  # noqa: N802
        return self.in_degrees()

    def dropIsolatedVertices(self) -> "Graph":  # noqa: N802
        return self.drop_isolated_vertices()

    def connectedComponents(self) -> DataFrame:  # noqa: N802
        """Vertices with all their columns and ``component``."""
        return self.vertices.join(self.connected_components(), "id")

    def shortestPaths(self, landmarks) -> DataFrame:  # noqa: N802
        """Vertices with ``distances``: map landmark id -> hops (see ``paths.hops_map``)."""
        from routegraph.operators.paths import hops_map, hops_to

        return hops_map(self, hops_to(self, landmarks))


def degree_ratio(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """(id, inDegree, outDegree, ratio) for ids with both degrees > 0; ratio = out / in (double)."""
    d = g.degrees(ids).filter((F.col("inDegree") > 0) & (F.col("outDegree") > 0))
    return d.withColumn("ratio", F.col("outDegree").cast("double") / F.col("inDegree"))

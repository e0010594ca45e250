"""Graph export as Graphviz DOT text, produced and written by the executors.

The reference draws a small carrier subgraph by collecting every edge and vertex to the
driver. Here each edge and vertex becomes one DOT statement in a distributed
``select``; ``write_dot`` writes them with ``DataFrame.write.text`` under a header and
footer line, so nothing passes through the driver and the export scales with the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegraph.operators.graph import Graph


def _quoted(c: Column) -> Column:
    """DOT double-quoted string (backslash and quote escaped); NULL becomes an empty string."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), s, F.lit('"'))


def dot_statements(g: Graph, edge_label: str, vertex_label: str) -> DataFrame:
    """One row per DOT statement: ``"src" -> "dst" [label="…"];`` and ``"id" [label="…"];``."""
    edges = g.edges.select(
        F.concat(
            _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")),
            F.lit(" [label="), _quoted(F.col(edge_label)), F.lit("];"),
        ).alias("statement")
    )
    nodes = g.vertices.select(
        F.concat(
            _quoted(F.col("id")), F.lit(" [label="), _quoted(F.col(vertex_label)), F.lit("];")
        ).alias("statement")
    )
    return nodes.unionByName(edges)


def write_dot(g: Graph, path: str, edge_label: str, vertex_label: str, name: str = "G") -> None:
    """Write a ``digraph`` to ``path`` (a directory of text parts, in order).

    A union keeps the order of its inputs' partitions, so the header is the first part and
    the footer the last, and the statements in between are neither sorted nor shuffled.
    """
    spark = g.vertices.sparkSession

    def line(text: str) -> DataFrame:
        return spark.range(0, 1, 1, 1).select(F.lit(text).alias("statement"))

    body = dot_statements(g, edge_label, vertex_label)
    line(f"digraph {name} {{").unionByName(body).unionByName(line("}")).write.mode("overwrite").text(path)

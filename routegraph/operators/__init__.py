"""Graph operators on plain DataFrames (degrees, subgraphs, motifs, hops, paths, components, message
passing, ranking, triangles, export), and joins on time."""

from routegraph.operators.components import component_sizes, connected_components
from routegraph.operators.export import dot_statements, write_dot
from routegraph.operators.graph import Graph, degree_ratio
from routegraph.operators.messages import Program, Rounds, hops_by_messages, pass_messages
from routegraph.operators.motif import Edge, Not, attach, count_matches, find
from routegraph.operators.paths import hops_compare, hops_map, hops_pair, hops_to, shortest_paths
from routegraph.operators.ranking import label_propagation, pagerank
from routegraph.operators.temporal import asof_join, interval_join
from routegraph.operators.triangles import triangle_counts, triangles

__all__ = [
    "Edge",
    "Graph",
    "Not",
    "Program",
    "Rounds",
    "asof_join",
    "attach",
    "component_sizes",
    "connected_components",
    "count_matches",
    "degree_ratio",
    "dot_statements",
    "find",
    "hops_by_messages",
    "hops_compare",
    "hops_map",
    "hops_pair",
    "hops_to",
    "interval_join",
    "label_propagation",
    "pagerank",
    "pass_messages",
    "shortest_paths",
    "triangle_counts",
    "triangles",
    "write_dot",
]

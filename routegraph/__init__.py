"""routegraph: route-network analytics (relational + graph) on plain PySpark DataFrames."""

from routegraph.functions import haversine_km
from routegraph.operators import (
    Edge,
    Graph,
    Not,
    component_sizes,
    connected_components,
    count_matches,
    degree_ratio,
    find,
    hops_compare,
    hops_map,
    hops_to,
)
from routegraph.plans.network import Network

__all__ = [
    "Edge",
    "Graph",
    "Network",
    "Not",
    "component_sizes",
    "connected_components",
    "count_matches",
    "degree_ratio",
    "find",
    "haversine_km",
    "hops_compare",
    "hops_map",
    "hops_to",
]

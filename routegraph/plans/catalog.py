"""Registry of the named queries: key -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from routegraph.plans import reports as R
from routegraph.plans import timelines as T
from routegraph.plans.network import Network
from routegraph.plans.params import (
    CARRIERS,
    CLICK_WINDOW_S,
    COUNTRY_THRESHOLD,
    HUB,
    LABEL_ROUNDS,
    LANDMARK_A,
    LANDMARK_B,
    LOOKUP_NAME,
    MIN_CITIES,
    MIN_COMPONENT_SIZE,
    NO_RETURN_ORIGIN,
    RANK_ROUNDS,
    TOP_AIRLINES,
    TOP_RATIO,
    TOP_ROUTES,
)

Query = Callable[[SparkSession, str], DataFrame]


def _on_network(fn: Callable[[Network], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Network.from_test_tables(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _scan(n: Network) -> DataFrame:
    return n.routes


def _clean(n: Network) -> DataFrame:
    return n.clean_routes()


def _vertices(n: Network) -> DataFrame:
    return n.graph().vertices.select("id", "name", "icao", "city", "country")


def _edges(n: Network) -> DataFrame:
    return n.graph().edges


A, B = LANDMARK_A, LANDMARK_B

QUERIES: dict[str, Query] = {
    # sources / cleaning
    "scan_routes": _on_network(_scan),
    "routes_clean": _on_network(_clean),
    "route_counts_clean": _on_network(R.route_counts_clean),
    "vertices": _on_network(_vertices),
    "edges": _on_network(_edges),
    # relational questions
    "airports_per_country": _on_network(R.airports_per_country),
    "countries_over": _on_network(lambda n: R.countries_over(n, COUNTRY_THRESHOLD)),
    "top_airlines": _on_network(lambda n: R.top_airlines(n, TOP_AIRLINES)),
    "top_routes": _on_network(lambda n: R.top_routes(n, TOP_ROUTES)),
    "distinct_route_count": _on_network(R.distinct_route_count),
    "carrier_routes": _on_network(lambda n: n.carrier_routes()),
    "carriers_min_cities": _on_network(lambda n: R.carriers_min_cities(n, MIN_CITIES)),
    "carriers_min_city_rows": _on_network(lambda n: R.carriers_min_city_rows(n, MIN_CITIES)),
    # degrees
    "out_degrees": _on_network(R.out_degrees),
    "in_degrees": _on_network(R.in_degrees),
    "degree_ratio": _on_network(lambda n: R.degree_ratio_top(n, TOP_RATIO)),
    "lookup_by_name": _on_network(lambda n: R.lookup_by_name(n, LOOKUP_NAME)),
    # motifs
    "reach_in_1": _on_network(lambda n: R.reach_in_1(n, HUB)),
    "reach_out_1": _on_network(lambda n: R.reach_out_1(n, HUB)),
    "reach_named": _on_network(lambda n: R.reach_named(n, LOOKUP_NAME)),
    "reach_out_2": _on_network(lambda n: R.reach_out_2(n, HUB)),
    "two_flight_walks": _on_network(R.two_flight_walks),
    "motif_no_return": _on_network(lambda n: R.motif_no_return(n, NO_RETURN_ORIGIN)),
    "motif_struct_fields": _on_network(lambda n: R.motif_struct_fields(n, NO_RETURN_ORIGIN)),
    "no_return_counts": _on_network(lambda n: R.no_return_counts(n, NO_RETURN_ORIGIN)),
    # distances
    "haversine": _on_network(R.route_lengths),
    "nearest_no_return": _on_network(lambda n: R.nearest_no_return(n, NO_RETURN_ORIGIN)),
    "nearest_trip_total": _on_network(lambda n: R.nearest_trip_total(n, NO_RETURN_ORIGIN)),
    "two_leg_distance": _on_network(lambda n: R.two_leg_distance(n, NO_RETURN_ORIGIN)),
    # hops
    "hops_to_landmarks": _on_network(lambda n: R.hops_long(n, [A, B])),
    "hops_to_named": _on_network(lambda n: R.hops_to_named(n, LOOKUP_NAME)),
    "hops_map": _on_network(lambda n: R.hops_text(n, [A, B])),
    "hops_map_lookup": _on_network(lambda n: R.hops_map_lookup(n, A, B)),
    "hops_closer_to_a": _on_network(lambda n: R.hops_filtered(n, A, B, "closer_to_a")),
    "hops_closer_to_b": _on_network(lambda n: R.hops_filtered(n, A, B, "closer_to_b")),
    "hops_equal": _on_network(lambda n: R.hops_filtered(n, A, B, "equal")),
    "hops_compare": _on_network(lambda n: R.hops_compare(n, A, B)),
    # components
    "non_isolated": _on_network(R.non_isolated),
    "components": _on_network(R.components),
    "component_sizes": _on_network(lambda n: R.component_sizes_report(n, MIN_COMPONENT_SIZE)),
    "component_count": _on_network(lambda n: R.component_count(n, MIN_COMPONENT_SIZE)),
    # carrier subgraph
    "carrier_subgraph": _on_network(lambda n: R.carrier_subgraph(n, CARRIERS)),
    "carrier_components": _on_network(lambda n: R.carrier_components(n, CARRIERS)),
    "dot_export": _on_network(lambda n: R.dot_export(n, CARRIERS)),
    # vertex programs and paths
    "pagerank": _on_network(lambda n: R.airport_ranks(n, RANK_ROUNDS)),
    "hops_by_messages": _on_network(lambda n: R.hops_as_messages(n, A)),
    "triangle_counts": _on_network(R.airport_triangles),
    "label_propagation": _on_network(lambda n: R.airport_labels(n, LABEL_ROUNDS)),
    "shortest_path_steps": _on_network(lambda n: R.path_steps(n, [A, B])),
    # time
    "last_click": T.last_click,
    "order_before_shipment": T.order_before_shipment,
    "errors_after_click": lambda spark, sf: T.errors_after_click(spark, sf, CLICK_WINDOW_S),
    "hourly_stream": T.hourly_stream,
    # summaries
    "user_sketches": T.user_sketches,
    "flights_cube": _on_network(R.flights_cube),
}

# Smoke entry: the widest single question (motif with negation, vertex attributes,
# native distance, arg-min).
FLAGSHIP = "nearest_no_return"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, sf_dir)


__all__ = ["FLAGSHIP", "QUERIES", "flagship"]

"""Unit tests on the hand-made graph of FIXTURES.md §2 (expected answers computed by hand)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from routegraph.functions import haversine_km
from routegraph.operators import (
    Edge,
    Graph,
    Not,
    attach,
    component_sizes,
    connected_components,
    count_matches,
    degree_ratio,
    dot_statements,
    find,
    hops_compare,
    hops_map,
    hops_pair,
    hops_to,
)
from routegraph.sources import clean_routes


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_clean_routes_drops_missing_endpoints(hand_routes):
    assert hand_routes.count() == 14
    assert clean_routes(hand_routes).count() == 12


def test_degrees(hand_graph):
    assert as_dict(hand_graph.out_degrees(), "id", "outDegree") == {1: 3, 2: 3, 3: 2, 4: 1, 5: 1, 6: 1, 8: 1}
    assert as_dict(hand_graph.in_degrees(), "id", "inDegree") == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 8: 2, 99: 1}
    both = {r["id"]: (r["inDegree"], r["outDegree"]) for r in hand_graph.degrees().collect()}
    assert both[6] == (0, 1) and both[99] == (1, 0) and both[1] == (2, 3)


def test_degree_ratio(hand_graph):
    r = degree_ratio(hand_graph).join(hand_graph.vertex_ids(), "id")
    assert as_dict(r, "id", "ratio") == {1: 1.5, 2: 1.5, 3: 1.0, 4: 0.5, 5: 1.0, 8: 0.5}


def test_one_edge_motifs(hand_graph):
    into_1 = find(hand_graph, [Edge("a", "b")], seeds={"b": [1]})
    assert {r["a"] for r in into_1.collect()} == {2, 4}
    from_1 = find(hand_graph, [Edge("a", "b")], seeds={"a": [1]})
    # parallel edges repeat; the dangling edge 1->99 never matches
    assert sorted(r["b"] for r in from_1.collect()) == [2, 2]


def test_two_edge_walks(hand_graph):
    walks = find(hand_graph, [Edge("a", "b"), Edge("b", "c")])
    assert walks.count() == 19
    from_1 = find(hand_graph, [Edge("a", "b"), Edge("b", "c")], seeds={"a": [1]})
    assert from_1.count() == 6
    assert {r["c"] for r in from_1.collect()} == {1, 3, 4}


def test_count_matches_agrees_with_rows(hand_graph):
    pattern = [Edge("a", "b"), Edge("b", "c")]
    counted = as_dict(count_matches(hand_graph, pattern, keep=["c"], seeds={"a": [1]}), "c", "n_matches")
    rows = find(hand_graph, pattern, seeds={"a": [1]}).groupBy("c").count()
    assert counted == as_dict(rows, "c", "count")
    total = count_matches(hand_graph, pattern, keep=[]).first()["n_matches"]
    assert total == 19


def test_seed_as_dataframe(hand_graph, spark):
    seeds = hand_graph.vertices.filter(F.col("name") == "Airport 1").select("id")
    from_1 = find(hand_graph, [Edge("a", "b"), Edge("b", "c")], seeds={"a": seeds})
    assert from_1.count() == 6


def test_negated_motif(hand_graph):
    pattern = [Edge("a", "b"), Edge("b", "c"), Not(Edge("c", "a")), Not(Edge("b", "a"))]
    got = {(r["a"], r["b"], r["c"]) for r in find(hand_graph, pattern).collect()}
    assert got == {(2, 3, 4), (2, 3, 5), (3, 4, 1), (6, 8, 8)}
    seeded = {(r["a"], r["b"], r["c"]) for r in find(hand_graph, pattern, seeds={"a": [2]}).collect()}
    assert seeded == {(2, 3, 4), (2, 3, 5)}


def test_named_edge_and_attach(hand_graph):
    m = find(hand_graph, [Edge("a", "b", name="e")], seeds={"a": [3]})
    assert {r["e"]["airline_id"] for r in m.collect()} == {11}
    s = attach(m.select("a", "b"), hand_graph, "b", ["id", "name"])
    assert {r["b"]["name"] for r in s.select("b").collect()} == {"Airport 4", "Airport 5"}


def test_invalid_patterns(hand_graph):
    with pytest.raises(ValueError):
        find(hand_graph, [Edge("a", "b"), Edge("c", "d")])  # disconnected: would be a cross join
    with pytest.raises(ValueError):
        find(hand_graph, [Edge("a", "b"), Not(Edge("b", "z"))])  # unbound negation
    with pytest.raises(ValueError):
        count_matches(hand_graph, [Edge("a", "b"), Not(Edge("b", "a"))], keep=["a"])
    with pytest.raises(ValueError):
        find(hand_graph, [Edge("a", "b")], seeds={"x": [1]})  # seed for an unknown name


def test_cycle_and_self_loop_terms(hand_graph):
    # a -> b -> a: 2-cycles, with parallel edges counted (1->2 twice, 2->1 once)
    cyc = count_matches(hand_graph, [Edge("a", "b"), Edge("b", "a")], keep=["a"])
    assert as_dict(cyc, "a", "n_matches") == {1: 2, 2: 2, 3: 1, 5: 1, 8: 1}  # 8->8 binds a=b=8
    loops = find(hand_graph, [Edge("a", "a")])
    assert [r["a"] for r in loops.collect()] == [8]


def test_hops(hand_graph):
    h = hops_to(hand_graph, [1, 5])
    to1 = {r["id"]: r["hops"] for r in h.filter("landmark = 1").collect()}
    to5 = {r["id"]: r["hops"] for r in h.filter("landmark = 5").collect()}
    assert to1 == {1: 0, 2: 1, 4: 1, 3: 2, 5: 3}
    assert to5 == {5: 0, 3: 1, 2: 2, 1: 3, 4: 4}
    p = hops_pair(h, 1, 5)
    nearer1 = {r["id"] for r in p.filter("hops_to_a < hops_to_b").collect()}
    nearer5 = {r["id"] for r in p.filter("hops_to_a > hops_to_b").collect()}
    assert nearer1 == {1, 2, 4} and nearer5 == {3, 5}
    c = hops_compare(h, 1, 5).first()
    assert (c["n_closer_to_a"], c["n_closer_to_b"], c["n_equal"]) == (3, 2, 0)


def test_hops_max_and_unknown_landmark(hand_graph):
    h = hops_to(hand_graph, [1], max_hops=1)
    assert {r["id"] for r in h.collect()} == {1, 2, 4}
    assert hops_to(hand_graph, [99, 12345]).count() == 0  # not vertices


def test_hops_landmarks_as_dataframe(hand_graph):
    lm = hand_graph.vertices.filter(F.col("name").isin("Airport 1", "Airport 5")).select("id")
    h = hops_to(hand_graph, lm)
    assert {(r["id"], r["landmark"]): r["hops"] for r in h.collect()} == {
        (r["id"], r["landmark"]): r["hops"] for r in hops_to(hand_graph, [1, 5]).collect()
    }


def test_hops_map(hand_graph):
    m = hops_map(hand_graph, hops_to(hand_graph, [1, 5]))
    d = {r["id"]: dict(r["distances"]) for r in m.collect()}
    assert d[5] == {1: 3, 5: 0} and d[6] == {} and d[7] == {}
    look = m.select("id", F.col("distances")[F.lit(5).cast("bigint")].alias("h")).filter("id = 4")
    assert look.first()["h"] == 4


def test_components(hand_graph):
    clean = hand_graph.drop_isolated_vertices()
    assert {r["id"] for r in clean.vertices.collect()} == {1, 2, 3, 4, 5, 6, 8}
    comp = as_dict(connected_components(clean), "id", "component")
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 8: 6}
    full = as_dict(connected_components(hand_graph), "id", "component")
    assert full[7] == 7
    sizes = as_dict(component_sizes(connected_components(clean), 2), "component", "size")
    assert sizes == {1: 5, 6: 2}


def test_subgraph(hand_graph):
    sub = hand_graph.subgraph(F.col("airline_id") == 12)
    assert {r["id"] for r in sub.vertices.collect()} == {1, 6, 8}
    assert sub.edges.count() == 3


def test_dot_statements(hand_graph):
    sub = hand_graph.subgraph(F.col("airline_id") == 12)
    lines = {r["statement"] for r in dot_statements(sub, "airline_id", "name").collect()}
    assert '"6" -> "8" [label="12"];' in lines
    assert '"8" [label="Airport 8"];' in lines
    assert len(lines) == 6


def test_graph_library_aliases(hand_graph):
    assert as_dict(hand_graph.outDegrees, "id", "outDegree")[1] == 3
    assert as_dict(hand_graph.inDegrees, "id", "inDegree")[99] == 1
    clean = hand_graph.dropIsolatedVertices()
    labelled = clean.connectedComponents()
    assert labelled.columns == [*clean.vertices.columns, "component"]
    assert as_dict(labelled, "id", "component")[8] == 6
    sp = {r["id"]: dict(r["distances"]) for r in hand_graph.shortestPaths([1]).collect()}
    assert sp[5] == {1: 3} and sp[7] == {}


def test_write_dot(hand_graph, tmp_path):
    from routegraph.operators import write_dot

    sub = hand_graph.subgraph(F.col("airline_id") == 12)
    out = str(tmp_path / "g.dot")
    write_dot(sub, out, edge_label="airline_id", vertex_label="name", name="carriers")
    import glob

    lines = []
    for part in sorted(glob.glob(out + "/part-*")):
        lines += open(part).read().splitlines()
    assert lines[0] == "digraph carriers {" and lines[-1] == "}"
    assert '"6" -> "8" [label="12"];' in lines and len(lines) == 8


def test_graph_validation(spark):
    v = spark.createDataFrame([(1, "x")], "id bigint, name string")
    with pytest.raises(ValueError):
        Graph(v, spark.createDataFrame([(1, 2)], "a bigint, b bigint"))
    with pytest.raises(TypeError):
        Graph(spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([(1, 2)], "src bigint, dst bigint"))


def test_haversine_golden(spark):
    d = spark.range(1).select(
        haversine_km(-19.62444305419922, -43.97194290161133, -34.5592, -58.4156).alias("d")
    ).first()["d"]
    assert d == 2186.1514575333313
    z = spark.range(1).select(haversine_km(10.0, 20.0, 10.0, 20.0).alias("z"), haversine_km(None, 1.0, 2.0, 3.0).alias("n")).first()
    assert z["z"] == 0.0 and z["n"] is None


def test_two_leg_sum_golden():
    # The reference adds its two printed leg lengths by hand.
    assert abs((2186.1514575333313 + 1210.6138281258875) - 3396.76529) < 1e-5


def test_haversine_second_pair_and_antipodes(spark):
    import math

    d = spark.range(1).select(
        haversine_km(0.0, 0.0, 0.0, 90.0).alias("quarter"),
        haversine_km(90.0, 0.0, -90.0, 0.0).alias("poles"),
        haversine_km(45.0, 10.0, -45.0, -170.0).alias("antipodes"),
    ).first()
    half = math.pi * 6371.0
    assert d["quarter"] == pytest.approx(half / 2, abs=1e-6)
    assert d["poles"] == pytest.approx(half, abs=1e-6) and d["antipodes"] == pytest.approx(half, abs=1e-4)


def _net(spark, places, flights):
    from routegraph.plans.network import Network

    a = spark.createDataFrame(
        places, "id bigint, name string, city string, country string, iata string, icao string, latitude double, longitude double"
    )
    r = spark.createDataFrame(flights, "airline_id bigint, airport_source_id bigint, airport_destination_id bigint")
    return Network(a, None, r)


def test_nearest_by_true_distance(spark):
    from routegraph.plans import reports as R

    # 4 lies 0.2 m nearer to 1 than 3 does: both round to the same metre
    km = 6371.0 * 3.141592653589793 / 180
    places = [(i, f"P{i}", "c", "l", "x", "y", lat, 0.0) for i, lat in [(1, 0.0), (2, 5.0), (3, 100.0002 / km), (4, 100.0 / km)]]
    net = _net(spark, places, [(1, 1, 2), (1, 2, 3), (1, 2, 4)])
    rows = {r["c"]: r["total_km"] for r in R.two_leg_distance(net, 1).collect()}
    assert set(rows) == {3, 4}
    best = R.nearest_no_return(net, 1).first()
    assert best["id"] == 4 and best["distance_km"] == 100.0
    trip = R.nearest_trip_total(net, 1).first()
    assert (trip["a"], trip["b"], trip["c"]) == (1, 2, 4) and trip["total_km"] == rows[4]


def test_components_cap_is_the_callers(hand_graph):
    with pytest.raises(RuntimeError):
        connected_components(hand_graph, max_rounds=0)

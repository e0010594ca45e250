"""Independent DuckDB SQL for every registered query (the correctness oracle).

The derived network is restated as SQL CTEs over the raw test tables; graph questions
use joins and NOT EXISTS (motifs) and recursive CTEs with ``USING KEY`` (hops,
components), so none of the Spark operators is reused here. Column names match the
Spark results exactly.
"""

from __future__ import annotations

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


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance on a sphere of 6371 km, by atan2: not the product's formula."""
    a = (
        f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(12742.0::DOUBLE * atan2(sqrt(least({a}, 1.0)), sqrt(greatest(1.0 - {a}, 0.0))))"


_BASE = """
airports AS (
  SELECT c_custkey AS id, c_name AS name,
         concat(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR)) AS city, n_name AS country,
         CASE WHEN c_acctbal >= 0 THEN c_name END AS iata, c_name AS icao,
         CAST((c_custkey * 7919) % 18000 AS DOUBLE) / 100 - 90 AS latitude,
         CAST((c_custkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
airlines AS (
  SELECT s_suppkey AS airline_id, s_name AS name, n_name AS country,
         concat('C', CAST(s_suppkey AS VARCHAR)) AS icao
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
routes AS (
  SELECT l_suppkey AS airline_id, o_custkey AS airport_source_id,
         CASE WHEN l_discount = CAST(0.1 AS DOUBLE) THEN NULL
              ELSE l_partkey % (SELECT count(*) FROM customer) END AS airport_destination_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
clean AS (
  SELECT airline_id, airport_source_id, airport_destination_id FROM routes
  WHERE airport_source_id IS NOT NULL AND airport_destination_id IS NOT NULL),
e AS (SELECT airport_source_id AS src, airport_destination_id AS dst, airline_id FROM clean),
re AS (SELECT src, dst, airline_id FROM e
       WHERE src IN (SELECT id FROM airports) AND dst IN (SELECT id FROM airports)),
degs AS (
  SELECT o.id, i.inDegree, o.outDegree, CAST(o.outDegree AS DOUBLE) / i.inDegree AS ratio
  FROM (SELECT src AS id, count(*) AS outDegree FROM e GROUP BY src) o
  JOIN (SELECT dst AS id, count(*) AS inDegree FROM e GROUP BY dst) i ON o.id = i.id),
carrier_e AS (
  SELECT c.airport_source_id AS src, c.airport_destination_id AS dst, a.icao, a.name AS airline_name
  FROM clean c JOIN airlines a ON c.airline_id = a.airline_id
  WHERE a.icao IN ({carriers})),
carrier_v AS (
  SELECT id, city FROM airports WHERE id IN (SELECT src FROM carrier_e UNION SELECT dst FROM carrier_e)),
no_return AS (
  SELECT DISTINCT e1.src AS a, e1.dst AS b, e2.dst AS c
  FROM re e1 JOIN re e2 ON e1.dst = e2.src
  WHERE e1.src = {origin}
    AND NOT EXISTS (SELECT 1 FROM e x WHERE x.src = e2.dst AND x.dst = e1.src)
    AND NOT EXISTS (SELECT 1 FROM e x WHERE x.src = e1.dst AND x.dst = e1.src)),
legs AS (
  SELECT m.a, m.b, m.c, pc.name AS c_name,
         pa.latitude AS a_lat, pa.longitude AS a_lon, pb.latitude AS b_lat, pb.longitude AS b_lon,
         pc.latitude AS c_lat, pc.longitude AS c_lon
  FROM no_return m JOIN airports pa ON m.a = pa.id JOIN airports pb ON m.b = pb.id
  JOIN airports pc ON m.c = pc.id)
"""

# Reverse breadth-first search from the landmarks: each round adds only vertices not yet
# keyed, so a vertex keeps the hop count of the round that first reached it.
_HOPS = """,
hop_e AS (SELECT DISTINCT src, dst FROM re WHERE src <> dst),
hops(id, landmark, hops) USING KEY (id, landmark) AS (
  SELECT id, id, 0 FROM airports WHERE id IN ({a}, {b})
  UNION
  (SELECT g.src, h.landmark, min(h.hops) + 1
   FROM hops h JOIN hop_e g ON g.dst = h.id
   LEFT JOIN recurring.hops r ON r.id = g.src AND r.landmark = h.landmark
   WHERE r.id IS NULL
   GROUP BY g.src, h.landmark)),
pair AS (
  SELECT id, min(CASE WHEN landmark = {a} THEN hops END) AS hops_to_a,
             min(CASE WHEN landmark = {b} THEN hops END) AS hops_to_b
  FROM hops GROUP BY id
  HAVING min(CASE WHEN landmark = {a} THEN hops END) IS NOT NULL
     AND min(CASE WHEN landmark = {b} THEN hops END) IS NOT NULL)
"""

# Minimum-label propagation over the undirected edge set of ``{edges}``.
_COMPONENTS = """,
u AS (SELECT src AS a, dst AS b FROM {edges} WHERE src <> dst
      UNION SELECT dst, src FROM {edges} WHERE src <> dst),
lab(id, comp) USING KEY (id) AS (
  SELECT id, id FROM (SELECT DISTINCT a AS id FROM u)
  UNION
  (SELECT u.b, min(l.comp) FROM lab l JOIN u ON u.a = l.id
   JOIN recurring.lab r ON r.id = u.b WHERE l.comp < r.comp GROUP BY u.b))
"""


def _with(body: str, *extra: str, recursive: bool = False) -> str:
    base = _BASE.format(
        carriers=", ".join(f"'{c}'" for c in CARRIERS), origin=NO_RETURN_ORIGIN
    )
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head}{base}{''.join(extra)}\n{body.strip()}"


def _hops(body: str) -> str:
    return _with(body, _HOPS.format(a=LANDMARK_A, b=LANDMARK_B), recursive=True)


_HAV_AC = _km("a_lat", "a_lon", "c_lat", "c_lon")
_HAV_AB = _km("a_lat", "a_lon", "b_lat", "b_lon")
_HAV_BC = _km("b_lat", "b_lon", "c_lat", "c_lon")
_NON_ISOLATED = "SELECT id FROM airports WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)"
_COMPONENTS_BODY = f"""
SELECT v.id, coalesce(l.comp, v.id) AS component
FROM ({_NON_ISOLATED}) v LEFT JOIN lab l ON l.id = v.id"""


def _ranks(rounds: int) -> str:
    """PageRank, a common table expression for each round."""
    steps = [
        """,
pr_pairs AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS n FROM re GROUP BY src, dst),
pr_out AS MATERIALIZED (SELECT src, sum(n) AS total FROM pr_pairs GROUP BY src),
pr_0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM airports) AS rank FROM airports)"""
    ]
    for k in range(1, rounds + 1):
        steps.append(
            f""",
pr_{k} AS MATERIALIZED (
  SELECT v.id, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM pr_{k - 1} WHERE id NOT IN (SELECT src FROM pr_out)))
      / (SELECT count(*) FROM airports) + 0.85 * coalesce(m.rank, 0) AS rank
  FROM airports v LEFT JOIN (
    SELECT p.dst AS id, sum(r.rank * p.n / o.total) AS rank
    FROM pr_{k - 1} r JOIN pr_pairs p ON p.src = r.id JOIN pr_out o ON o.src = r.id GROUP BY p.dst) m ON m.id = v.id)"""
        )
    return "".join(steps)


def _labels(rounds: int) -> str:
    """Label propagation, a common table expression for each round."""
    steps = [
        """,
lp_pairs AS MATERIALIZED (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, dst FROM re WHERE src <> dst UNION ALL SELECT dst, src FROM re WHERE src <> dst) GROUP BY src, dst),
lp_0 AS MATERIALIZED (SELECT id, id AS label FROM airports)"""
    ]
    for k in range(1, rounds + 1):
        steps.append(
            f""",
lp_{k} AS MATERIALIZED (
  SELECT l.id, coalesce(m.label, l.label) AS label
  FROM lp_{k - 1} l LEFT JOIN (
    SELECT id, first(label ORDER BY votes DESC, label) AS label FROM (
      SELECT p.dst AS id, o.label, sum(p.n) AS votes FROM lp_pairs p JOIN lp_{k - 1} o ON o.id = p.src
      GROUP BY p.dst, o.label) GROUP BY id) m ON m.id = l.id)"""
        )
    return "".join(steps)


_WALK = """,
walk(origin, landmark, step, id, hops) AS (
  SELECT id, landmark, 0, id, hops FROM hops
  UNION ALL
  (SELECT w.origin, w.landmark, w.step + 1, min(g.dst), w.hops - 1
   FROM walk w JOIN hop_e g ON g.src = w.id
   JOIN hops h ON h.id = g.dst AND h.landmark = w.landmark AND h.hops = w.hops - 1
   WHERE w.hops > 0 GROUP BY w.origin, w.landmark, w.step, w.hops))
"""


def _q(s: str) -> str:
    """DOT double-quoted string, escaped like the Spark side."""
    return (
        "('\"' || replace(replace(coalesce(CAST(" + s + " AS VARCHAR), ''), '\\', '\\\\'), '\"', '\\\"') || '\"')"
    )


ORACLE_SQL: dict[str, str] = {
    "scan_routes": _with("SELECT airline_id, airport_source_id, airport_destination_id FROM routes"),
    "routes_clean": _with("SELECT airline_id, airport_source_id, airport_destination_id FROM clean"),
    "route_counts_clean": _with(
        """SELECT count(*) AS n_routes,
                  count(*) FILTER (WHERE airport_source_id IS NOT NULL
                                     AND airport_destination_id IS NOT NULL) AS n_clean
           FROM routes"""
    ),
    "vertices": _with("SELECT id, name, icao, city, country FROM airports"),
    "edges": _with("SELECT src, dst, airline_id FROM e"),
    "airports_per_country": _with(
        "SELECT country, count(id) AS n_airports FROM airports GROUP BY country"
    ),
    "countries_over": _with(
        f"""SELECT country, count(iata) AS n_airports FROM airports GROUP BY country
            HAVING count(iata) > {COUNTRY_THRESHOLD} ORDER BY n_airports DESC, country"""
    ),
    "top_airlines": _with(
        f"""SELECT * FROM (
              SELECT a.airline_id, a.name, a.icao, f.n_flights
              FROM airlines a JOIN (SELECT airline_id, count(airline_id) AS n_flights
                                    FROM routes GROUP BY airline_id) f ON a.airline_id = f.airline_id
              ORDER BY f.n_flights DESC, a.airline_id LIMIT {TOP_AIRLINES})
            ORDER BY n_flights, airline_id DESC"""
    ),
    "top_routes": _with(
        f"""SELECT p.airport_source_id, p.airport_destination_id, s.name AS source_name,
                   s.city AS source_city, d.name AS destination_name, d.city AS destination_city,
                   p.n_flights
            FROM (SELECT airport_source_id, airport_destination_id,
                         count(airport_source_id) AS n_flights
                  FROM routes GROUP BY airport_source_id, airport_destination_id) p
            JOIN airports s ON p.airport_source_id = s.id
            JOIN airports d ON p.airport_destination_id = d.id
            ORDER BY p.n_flights DESC, p.airport_source_id, p.airport_destination_id
            LIMIT {TOP_ROUTES}"""
    ),
    "distinct_route_count": _with(
        """SELECT count(*) AS n_routes
           FROM (SELECT DISTINCT airport_source_id, airport_destination_id FROM routes)"""
    ),
    "carrier_routes": _with(
        """SELECT c.airport_source_id AS src, c.airport_destination_id AS dst, a.airline_id,
                  a.icao, a.name AS airline_name
           FROM clean c JOIN airlines a ON c.airline_id = a.airline_id"""
    ),
    "carriers_min_cities": _with(
        f"""SELECT l.icao, count(DISTINCT p.city) AS n_cities
            FROM (SELECT airline_id, airport_source_id AS id FROM clean
                  UNION ALL SELECT airline_id, airport_destination_id FROM clean) s
            JOIN airports p ON s.id = p.id JOIN airlines l ON s.airline_id = l.airline_id
            GROUP BY l.icao HAVING count(DISTINCT p.city) >= {MIN_CITIES}"""
    ),
    "carriers_min_city_rows": _with(
        f"""SELECT a.icao, count(p.city) AS n_city_rows
            FROM clean c JOIN airlines a ON c.airline_id = a.airline_id
            JOIN airports p ON c.airport_source_id = p.id
            GROUP BY a.icao HAVING count(p.city) >= {MIN_CITIES}"""
    ),
    "out_degrees": _with("SELECT src AS id, count(*) AS outDegree FROM e GROUP BY src"),
    "in_degrees": _with("SELECT dst AS id, count(*) AS inDegree FROM e GROUP BY dst"),
    "degree_ratio": _with(
        f"""SELECT p.name, d.id, d.inDegree, d.outDegree, d.ratio
            FROM degs d JOIN airports p ON p.id = d.id
            ORDER BY d.ratio DESC, d.id LIMIT {TOP_RATIO}"""
    ),
    "lookup_by_name": _with(
        f"""SELECT p.name, d.id, d.inDegree, d.outDegree, d.ratio
            FROM degs d JOIN airports p ON p.id = d.id WHERE p.name = '{LOOKUP_NAME}'"""
    ),
    "reach_in_1": _with(f"SELECT src AS id, count(*) AS n_flights FROM re WHERE dst = {HUB} GROUP BY src"),
    "reach_out_1": _with(f"SELECT dst AS id, count(*) AS n_flights FROM re WHERE src = {HUB} GROUP BY dst"),
    "reach_out_2": _with(
        f"""SELECT e2.dst AS id, count(*) AS n_walks
            FROM re e1 JOIN re e2 ON e1.dst = e2.src WHERE e1.src = {HUB} GROUP BY e2.dst"""
    ),
    "two_flight_walks": _with(
        """SELECT e1.src AS id, count(*) AS n_walks
           FROM re e1 JOIN re e2 ON e1.dst = e2.src GROUP BY e1.src"""
    ),
    "motif_no_return": _with("SELECT a, b, c FROM no_return"),
    "motif_struct_fields": _with(
        """SELECT pb.id AS b_id, pb.name AS b_name, pc.id AS c_id, pc.name AS c_name
           FROM no_return m JOIN airports pb ON m.b = pb.id JOIN airports pc ON m.c = pc.id"""
    ),
    "no_return_counts": _with(
        "SELECT count(*) AS n_paths, count(DISTINCT c) AS n_destinations FROM no_return"
    ),
    "haversine": _with(
        f"""SELECT p.src, p.dst, round({_km('s.latitude', 's.longitude', 'd.latitude', 'd.longitude')}, 3)
                   AS distance_km
            FROM (SELECT DISTINCT src, dst FROM e) p
            JOIN airports s ON p.src = s.id JOIN airports d ON p.dst = d.id"""
    ),
    "nearest_no_return": _with(
        f"""SELECT id, name, round(km, 3) AS distance_km
            FROM (SELECT DISTINCT c AS id, c_name AS name, {_HAV_AC} AS km FROM legs)
            ORDER BY km, id LIMIT 1"""
    ),
    "nearest_trip_total": _with(
        f"""SELECT a, b, c, round(ab, 3) AS d_ab_km, round(bc, 3) AS d_bc_km, round(ab + bc, 3) AS total_km
            FROM (SELECT a, b, c, {_HAV_AB} AS ab, {_HAV_BC} AS bc FROM legs
                  WHERE c = (SELECT c FROM legs ORDER BY {_HAV_AC}, c LIMIT 1))
            ORDER BY ab + bc, b LIMIT 1"""
    ),
    "reach_named": _with(
        f"""SELECT dst AS id, count(*) AS n_flights FROM re
            WHERE src IN (SELECT id FROM airports WHERE name = '{LOOKUP_NAME}') GROUP BY dst"""
    ),
    "two_leg_distance": _with(
        f"""SELECT a, b, c, round({_HAV_AB}, 3) AS d_ab_km, round({_HAV_BC}, 3) AS d_bc_km,
                   round({_HAV_AB} + {_HAV_BC}, 3) AS total_km
            FROM legs"""
    ),
    "hops_to_landmarks": _hops("SELECT id, landmark, hops FROM hops"),
    "hops_to_named": _hops(
        f"""SELECT id, landmark, hops FROM hops
            WHERE landmark IN (SELECT id FROM airports WHERE name = '{LOOKUP_NAME}')"""
    ),
    "hops_map": _hops(
        """SELECT v.id, v.name, coalesce(m.distances, '') AS distances
           FROM airports v LEFT JOIN (
             SELECT id, string_agg(landmark || ':' || hops, ',' ORDER BY landmark) AS distances
             FROM hops GROUP BY id) m ON m.id = v.id"""
    ),
    "hops_map_lookup": _hops(
        f"""SELECT v.id, ha.hops AS hops_to_a, hb.hops AS hops_to_b
            FROM airports v
            LEFT JOIN hops ha ON ha.id = v.id AND ha.landmark = {LANDMARK_A}
            LEFT JOIN hops hb ON hb.id = v.id AND hb.landmark = {LANDMARK_B}"""
    ),
    "hops_closer_to_a": _hops("SELECT id, hops_to_a, hops_to_b FROM pair WHERE hops_to_a < hops_to_b"),
    "hops_closer_to_b": _hops("SELECT id, hops_to_a, hops_to_b FROM pair WHERE hops_to_a > hops_to_b"),
    "hops_equal": _hops("SELECT id, hops_to_a, hops_to_b FROM pair WHERE hops_to_a = hops_to_b"),
    "hops_compare": _hops(
        """SELECT count(*) FILTER (WHERE hops_to_a < hops_to_b) AS n_closer_to_a,
                  count(*) FILTER (WHERE hops_to_a > hops_to_b) AS n_closer_to_b,
                  count(*) FILTER (WHERE hops_to_a = hops_to_b) AS n_equal
           FROM pair"""
    ),
    "non_isolated": _with(
        """SELECT id, name, icao, city, country, latitude, longitude FROM airports
           WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)"""
    ),
    "components": _with(_COMPONENTS_BODY, _COMPONENTS.format(edges="re"), recursive=True),
    "component_sizes": _with(
        f"""SELECT component, count(*) AS size FROM ({_COMPONENTS_BODY}) c
            GROUP BY component HAVING count(*) >= {MIN_COMPONENT_SIZE}""",
        _COMPONENTS.format(edges="re"),
        recursive=True,
    ),
    "component_count": _with(
        f"""SELECT count(*) AS n_components FROM (
              SELECT component FROM ({_COMPONENTS_BODY}) c
              GROUP BY component HAVING count(*) >= {MIN_COMPONENT_SIZE})""",
        _COMPONENTS.format(edges="re"),
        recursive=True,
    ),
    "carrier_subgraph": _with("SELECT id, city FROM carrier_v"),
    "carrier_components": _with(
        """SELECT v.id, coalesce(l.comp, v.id) AS component
           FROM carrier_v v LEFT JOIN lab l ON l.id = v.id""",
        ",\ncarrier_re AS (SELECT src, dst FROM carrier_e WHERE src IN (SELECT id FROM carrier_v)"
        " AND dst IN (SELECT id FROM carrier_v))",
        _COMPONENTS.format(edges="carrier_re"),
        recursive=True,
    ),
    "dot_export": _with(
        f"""SELECT {_q('id')} || ' [label=' || {_q('city')} || '];' AS statement FROM carrier_v
            UNION ALL
            SELECT {_q('src')} || ' -> ' || {_q('dst')} || ' [label=' || {_q('icao')} || '];'
            FROM carrier_e"""
    ),
    "pagerank": _with(f"SELECT id, round(rank, 9) AS rank FROM pr_{RANK_ROUNDS}", _ranks(RANK_ROUNDS)),
    "hops_by_messages": _hops(f"SELECT id, landmark, hops FROM hops WHERE landmark = {LANDMARK_A}"),
    "triangle_counts": _with(
        """SELECT v.id, count(t.id) AS n_triangles FROM airports v LEFT JOIN (
             SELECT unnest([a.x, a.y, b.y]) AS id
             FROM ud a JOIN ud b ON a.y = b.x JOIN ud c ON c.x = a.x AND c.y = b.y) t ON t.id = v.id
           GROUP BY v.id""",
        """,
ud AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM re WHERE src <> dst)""",
    ),
    "label_propagation": _with(f"SELECT id, label FROM lp_{LABEL_ROUNDS}", _labels(LABEL_ROUNDS)),
    "shortest_path_steps": _with(
        "SELECT origin, landmark, step, id FROM walk",
        _HOPS.format(a=LANDMARK_A, b=LANDMARK_B).rstrip() + _WALK,
        recursive=True,
    ),
    "last_click": """
        SELECT e.event_id, e.user_id, c.event_id AS click_id,
               round((epoch_us(e.ts) - epoch_us(c.ts)) / 1e6, 3) AS seconds
        FROM events e LEFT JOIN (
          SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) c
          ON c.user_id = e.user_id AND c.ts = (
            SELECT max(x.ts) FROM events x WHERE x.event_type = 'click' AND x.user_id = e.user_id AND x.ts < e.ts)""",
    "order_before_shipment": """
        SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, p.o_orderkey AS last_orderkey
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
        ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) p
          ON p.o_custkey = o.o_custkey AND p.o_orderdate <= l.l_shipdate""",
    "errors_after_click": f"""
        SELECT c.event_id AS click_id, e.event_id AS error_id
        FROM events c JOIN events e
          ON c.event_type = 'click' AND e.event_type = 'error'
         AND epoch_us(e.ts) BETWEEN epoch_us(c.ts) AND epoch_us(c.ts) + {CLICK_WINDOW_S * 1_000_000}""",
    "hourly_stream": """
        SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n_events,
               sum(round(value * 100)::BIGINT)::BIGINT AS cents
        FROM events
        GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type
        HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR
               <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE""",
    "user_sketches": """
        SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, true AS within_error
        FROM events GROUP BY event_type
        UNION ALL SELECT 'all kinds', count(*), count(DISTINCT user_id), true FROM events""",
    "flights_cube": _with(
        """SELECT l.icao, p.country, p.city, grouping(l.icao, p.country, p.city)::INT AS level, count(*) AS n_flights
           FROM clean c JOIN airports p ON c.airport_source_id = p.id JOIN airlines l ON c.airline_id = l.airline_id
           GROUP BY CUBE (l.icao, p.country, p.city)"""
    ),
}

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from routegraph.session import local_session  # noqa: E402
from routegraph.operators import Graph  # noqa: E402

# Hand-made graph (FIXTURES.md §2): vertices 1..8 (7 isolated); routes (airline, src, dst).
HAND_ROUTES = [
    (10, 1, 2), (11, 1, 2), (10, 2, 1), (10, 2, 3), (11, 3, 4), (10, 4, 1), (11, 3, 5),
    (10, 5, 3), (12, 6, 8), (12, 8, 8), (12, 1, 99), (None, 2, 4),
    (10, 1, None), (10, None, 2),
]


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, app="routegraph-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def hand_routes(spark):
    return spark.createDataFrame(
        HAND_ROUTES, "airline_id bigint, airport_source_id bigint, airport_destination_id bigint"
    )


@pytest.fixture(scope="session")
def hand_airports(spark):
    rows = [
        (i, f"Airport {i}", f"City{i % 3}", f"Country{i % 2}", f"A{i}", f"IC{i}", float(i), float(-i))
        for i in range(1, 9)
    ]
    return spark.createDataFrame(
        rows,
        "id bigint, name string, city string, country string, iata string, icao string, "
        "latitude double, longitude double",
    )


@pytest.fixture(scope="session")
def hand_graph(hand_routes, hand_airports):
    from routegraph.sources import clean_routes

    e = clean_routes(hand_routes).selectExpr(
        "airport_source_id as src", "airport_destination_id as dst", "airline_id"
    )
    return Graph(hand_airports.select("id", "name", "city", "latitude", "longitude"), e)

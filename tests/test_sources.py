"""Sources: CSV files as the reference reads them (header, extra columns, ``\\N`` missing)."""

from __future__ import annotations

from routegraph.plans import reports as R
from routegraph.plans.network import Network
from routegraph.sources import clean_routes, read_airlines, read_airports, read_routes

AIRPORTS_CSV = """id,name,city,country,iata,icao,latitude,longitude,altitude
1,Alpha Airport,Alpha,Landia,AAA,LAAA,-19.62444305419922,-43.97194290161133,100
2,Beta Field,Beta,Landia,\\N,LBBB,-34.5592,-58.4156,12
3,Gamma Intl,Gamma,Otherland,GGG,\\N,\\N,10.0,5
4,Alpha Airport,Delta,Otherland,DDD,ODDD,1.5,2.5,7
"""

AIRLINES_CSV = """airline_id,name,alias,country,icao
10,Air One,\\N,Landia,ONE
11,Two Air,\\N,Otherland,TWO
"""

ROUTES_CSV = """airline,airline_id,source_airport,airport_source_id,destination_airport,airport_destination_id
A1,10,AAA,1,\\N,2
A1,10,AAA,1,\\N,2
A1,10,BBB,2,\\N,3
A2,11,GGG,3,\\N,\\N
A2,\\N,GGG,\\N,\\N,1
A2,11,DDD,4,\\N,1
A2,11,GGG,3,\\N,4
"""


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_csv_readers_type_and_missing(spark, tmp_path):
    a = read_airports(spark, _write(tmp_path, "airports.csv", AIRPORTS_CSV))
    assert a.columns == ["id", "name", "city", "country", "iata", "icao", "latitude", "longitude"]
    assert dict(a.dtypes)["id"] == "bigint" and dict(a.dtypes)["latitude"] == "double"
    rows = {r["id"]: r for r in a.collect()}
    assert rows[2]["iata"] is None and rows[3]["icao"] is None and rows[3]["latitude"] is None
    r = read_routes(spark, _write(tmp_path, "routes.csv", ROUTES_CSV))
    assert r.count() == 7
    assert clean_routes(r).count() == 5  # "\N" endpoints dropped, NULL carrier kept
    assert read_airlines(spark, _write(tmp_path, "airlines.csv", AIRLINES_CSV)).count() == 2


def test_network_from_files_answers(spark, tmp_path):
    net = Network.from_files(
        spark,
        _write(tmp_path, "a.csv", AIRPORTS_CSV),
        _write(tmp_path, "l.csv", AIRLINES_CSV),
        _write(tmp_path, "r.csv", ROUTES_CSV),
    )
    counts = R.route_counts_clean(net).first()
    assert (counts["n_routes"], counts["n_clean"]) == (7, 5)
    # count(iata): the "\N" code of airport 2 is missing, so Landia has 1 coded airport
    per_country = {r["country"]: r["n_airports"] for r in R.countries_over(net, 0).collect()}
    assert per_country == {"Landia": 1, "Otherland": 2}
    top = R.top_routes(net, 1).first()
    assert (top["airport_source_id"], top["airport_destination_id"], top["n_flights"]) == (1, 2, 2)
    assert top["source_name"] == "Alpha Airport" and top["destination_city"] == "Beta"
    # the golden distance of the reference, through the report path (1 -> 2)
    lengths = {(r["src"], r["dst"]): r["distance_km"] for r in R.route_lengths(net).collect()}
    assert lengths[(1, 2)] == round(2186.1514575333313, 3)
    assert lengths[(2, 3)] is None  # NULL coordinate in, NULL out
    # names are not unique: both "Alpha Airport" rows (each with in and out flights) come back
    assert {r["id"] for r in R.lookup_by_name(net, "Alpha Airport").collect()} == {1, 4}
    cities = {r["icao"]: r["n_cities"] for r in R.carriers_min_cities(net, 1).collect()}
    assert cities == {"ONE": 3, "TWO": 3}


def test_parquet_reader(spark, tmp_path):
    net = Network.from_files(
        spark,
        _write(tmp_path, "a.csv", AIRPORTS_CSV),
        _write(tmp_path, "l.csv", AIRLINES_CSV),
        _write(tmp_path, "r.csv", ROUTES_CSV),
    )
    out = str(tmp_path / "routes.parquet")
    net.routes.write.parquet(out)
    r = read_routes(spark, out, fmt="parquet")
    assert sorted(r.columns) == ["airline_id", "airport_destination_id", "airport_source_id"]
    assert r.count() == 7


def test_graph_operators_on_csv_network(spark, tmp_path):
    from routegraph.operators import connected_components, hops_to

    net = Network.from_files(
        spark,
        _write(tmp_path, "a.csv", AIRPORTS_CSV),
        _write(tmp_path, "l.csv", AIRLINES_CSV),
        _write(tmp_path, "r.csv", ROUTES_CSV),
    )
    g = net.graph()
    # clean edges: 1->2 (x2), 2->3, 4->1, 3->4
    hops = {r["id"]: r["hops"] for r in hops_to(g, [1]).collect()}
    assert hops == {1: 0, 4: 1, 3: 2, 2: 3}
    comp = {r["id"]: r["component"] for r in connected_components(g).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1}


def test_separator_reaches_the_readers(spark, tmp_path):
    def semicolons(text):
        return text.replace(",", ";")

    net = Network.from_files(
        spark,
        _write(tmp_path, "a.csv", semicolons(AIRPORTS_CSV)),
        _write(tmp_path, "l.csv", semicolons(AIRLINES_CSV)),
        _write(tmp_path, "r.csv", semicolons(ROUTES_CSV)),
        sep=";",
    )
    assert net.airports.count() == 4 and net.clean_routes().count() == 5


def test_quoted_fields_and_unparsable_ids(spark, tmp_path):
    text = AIRPORTS_CSV + '5,"Quote, Comma Field","Big, City",Landia,QQQ,LQQQ,1.0,2.0,3\nabc,Bad Id,X,Landia,XXX,LXXX,1.0,2.0,3\n'
    rows = read_airports(spark, _write(tmp_path, "a.csv", text)).collect()
    assert any(r["name"] == "Quote, Comma Field" and r["city"] == "Big, City" for r in rows)
    assert [r["name"] for r in rows if r["id"] is None] == ["Bad Id"]


def test_several_files_with_equal_headers(spark, tmp_path):
    folder = tmp_path / "routes"
    folder.mkdir()
    head, *lines = ROUTES_CSV.splitlines()
    (folder / "1.csv").write_text("\n".join([head, *lines[:3]]) + "\n")
    (folder / "2.csv").write_text("\n".join([head, *lines[3:]]) + "\n")
    assert read_routes(spark, str(folder)).count() == 7

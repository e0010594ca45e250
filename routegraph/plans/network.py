"""The route network: three tables and the two graphs the questions run on."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegraph.operators.graph import Graph
from routegraph.sources import clean_routes
from routegraph.sources import tpch


class Network:
    """Three tables: airports (id, name, city, country, iata, icao, latitude, longitude),
    airlines (airline_id, name, country, icao) and raw routes (airline_id,
    airport_source_id, airport_destination_id). Each is given directly or built on first
    use, so a question only declares the tables it reads."""

    def __init__(self, airports=None, airlines=None, routes=None, *, loader=None) -> None:
        self._given = {"airports": airports, "airlines": airlines, "routes": routes}
        self._loader = loader

    def _table(self, name: str) -> DataFrame:
        df = self._given[name]
        if df is None:
            if self._loader is None:
                raise ValueError(f"network has no {name} table")
            df = self._given[name] = self._loader(name)
        return df

    @cached_property
    def airports(self) -> DataFrame:
        return self._table("airports")

    @cached_property
    def airlines(self) -> DataFrame:
        return self._table("airlines")

    @cached_property
    def routes(self) -> DataFrame:
        return self._table("routes")

    @classmethod
    def from_test_tables(cls, spark: SparkSession, sf_dir: str) -> "Network":
        builders = {"airports": tpch.airports, "airlines": tpch.airlines, "routes": tpch.routes}
        return cls(loader=lambda name: builders[name](spark, sf_dir))

    @classmethod
    def from_files(cls, spark: SparkSession, airports: str, airlines: str, routes: str,
                   fmt: str = "csv", sep: str = ",") -> "Network":
        """Route data files as the reference reads them (CSV with header, ``\\N`` = missing)."""
        from routegraph.sources import read_airlines, read_airports, read_routes

        return cls(read_airports(spark, airports, fmt, sep), read_airlines(spark, airlines, fmt, sep),
                   read_routes(spark, routes, fmt, sep))

    def clean_routes(self) -> DataFrame:
        return clean_routes(self.routes)

    def graph(self) -> Graph:
        """Flight graph: airports are vertices, each clean route row is one edge."""
        v = self.airports.select("id", "name", "icao", "city", "country", "latitude", "longitude")
        e = self.clean_routes().select(
            F.col("airport_source_id").alias("src"),
            F.col("airport_destination_id").alias("dst"),
            "airline_id",
        )
        return Graph(v, e)

    def carrier_routes(self) -> DataFrame:
        """Clean routes with their carrier's code and name (inner join on airline_id)."""
        r = self.clean_routes()
        a = self.airlines.select("airline_id", "icao", F.col("name").alias("airline_name"))
        return r.join(a, "airline_id").select(
            F.col("airport_source_id").alias("src"),
            F.col("airport_destination_id").alias("dst"),
            "airline_id",
            "icao",
            "airline_name",
        )

    def carrier_edges(self, icaos) -> Graph:
        """All airports, and the routes flown by the given carrier codes."""
        e = self.carrier_routes().filter(F.col("icao").isin(list(icaos)))
        return Graph(self.airports.select("id", "city"), e.select("src", "dst", "icao", "airline_name"))

    def carrier_graph(self, icaos) -> Graph:
        """Subgraph of the routes flown by the given carrier codes, isolated airports dropped."""
        return self.carrier_edges(icaos).drop_isolated_vertices()

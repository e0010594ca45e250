"""Readers for route data stored as files (CSV or Parquet).

The three inputs are tables of places (airports), carriers (airlines) and routes.
Files may carry more columns than we use; we select by *name* and cast with
``try_cast`` so malformed ids become NULL instead of failing the job (Spark 4 runs
with ANSI mode on, where a plain cast of ``\\N`` to a number raises).

CSV files are read without schema inference (inference is a full extra pass over
the data); every column arrives as a string and is typed here, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The missing-value token of the route data files, and the columns
# (with Spark SQL types) we keep from each table.
MISSING_TOKEN = "\\N"

AIRPORT_COLUMNS = {
    "id": "bigint",
    "name": "string",
    "city": "string",
    "country": "string",
    "iata": "string",
    "icao": "string",
    "latitude": "double",
    "longitude": "double",
}
AIRLINE_COLUMNS = {
    "airline_id": "bigint",
    "name": "string",
    "country": "string",
    "icao": "string",
}
ROUTE_COLUMNS = {
    "airline_id": "bigint",
    "airport_source_id": "bigint",
    "airport_destination_id": "bigint",
}


def _typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Project ``columns`` by name, casting each one with try_cast semantics."""
    present = set(df.columns)
    missing = [c for c in columns if c not in present]
    if missing:
        raise ValueError(f"input lacks columns {missing}; has {sorted(present)}")
    cols: list[Column] = []
    for name, sql_type in columns.items():
        c = F.col(name)
        if sql_type != "string":
            c = c.try_cast(sql_type)
        cols.append(c.alias(name))
    return df.select(*cols)


def _raw(spark: SparkSession, path: str, fmt: str, sep: str) -> DataFrame:
    if fmt == "csv":
        return (
            spark.read.option("header", True)
            .option("sep", sep)
            .option("nullValue", MISSING_TOKEN)
            .option("inferSchema", False)
            .csv(path)
        )
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}; use 'csv' or 'parquet'")


def read_airports(spark: SparkSession, path: str, fmt: str = "csv", sep: str = ",") -> DataFrame:
    return _typed(_raw(spark, path, fmt, sep), AIRPORT_COLUMNS)


def read_airlines(spark: SparkSession, path: str, fmt: str = "csv", sep: str = ",") -> DataFrame:
    return _typed(_raw(spark, path, fmt, sep), AIRLINE_COLUMNS)


def read_routes(spark: SparkSession, path: str, fmt: str = "csv", sep: str = ",") -> DataFrame:
    return _typed(_raw(spark, path, fmt, sep), ROUTE_COLUMNS)


def clean_routes(routes: DataFrame) -> DataFrame:
    """Drop routes whose source or destination id is missing (``\\N`` or unparsable)."""
    return routes.filter(
        F.col("airport_source_id").isNotNull() & F.col("airport_destination_id").isNotNull()
    )

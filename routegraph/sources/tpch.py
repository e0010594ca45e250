"""Route-network tables derived from the TPC-H-like test tables.

The reference analyses three files (airports, airlines, routes) that do not ship
with it. The test data are TPC-H-like tables, so we derive the same three tables
from them with one fixed mapping (customers are places, suppliers are carriers,
line items are flown routes). The mapping is plain DataFrame code so Catalyst can
prune columns and push filters all the way into the Parquet scans; the same
mapping is written in SQL for the DuckDB oracle (``routegraph.plans.oracle``).

Scale notes
* ``nation`` has 25 rows at every TPC-H scale factor, so broadcasting it is safe.
* ``lineitem`` x ``orders`` is the one large-large join (on ``orderkey``); Spark plans it
  as a sort-merge join. Where the session's shuffle partitions are too few for the line items
  (a metadata-only count), both sides are dealt to more (see ``spread``).
* The destination id uses the customer count as a modulus: one scalar subquery, a
  metadata-only count of a single table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegraph.sources.spread import spread


# The columns (and their stored types) this mapping reads from each test
# table. Declaring them skips Parquet footer schema inference on every read; Catalyst
# still prunes to the columns a query actually uses.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # TPC-H fixes nation at 25 rows: a proven size bound, so an explicit broadcast.
    return F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    n = _nation(spark, sf_dir)
    key = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.col("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string")).alias("city"),
        F.col("n_name").alias("country"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("iata"),
        F.col("c_name").alias("icao"),
        (((key * 7919) % 18000).cast("double") / 100 - 90).alias("latitude"),
        (((key * 104729) % 36000).cast("double") / 100 - 180).alias("longitude"),
    )


def airlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = _nation(spark, sf_dir)
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("airline_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("icao"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw routes: one row per (carrier, source, destination) flight; destination may be NULL."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_discount")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, sf_dir, "lineitem").count()
    li, o = spread(li, rows, "l_orderkey"), spread(o, rows, "o_orderkey")
    n_places = table(spark, sf_dir, "customer").select(F.count(F.lit(1))).scalar()
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").alias("airline_id"),
        F.col("o_custkey").alias("airport_source_id"),
        F.when(F.col("l_discount") == F.lit(0.1), F.lit(None).cast("bigint"))
        .otherwise(F.col("l_partkey") % n_places)
        .alias("airport_destination_id"),
    )

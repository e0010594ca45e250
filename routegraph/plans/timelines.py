"""Questions about events and shipments in time, over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegraph.operators.lineage import RoundTables, row_count
from routegraph.operators.sketches import distinct_estimate, merged, relative_error, sketched
from routegraph.operators.temporal import asof_join, interval_join
from routegraph.streaming import drained, event_stream, windowed_counts


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the last click of the same user before it, and the seconds in between."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    clicks = _events(spark, sf_dir).filter("event_type = 'click'").withColumn("at", F.col("ts"))
    found = asof_join(
        events, clicks, ["user_id"], "ts", "ts", {"event_id": "click_id", "at": "_clicked"}, strict=True
    )
    seconds = (micros(F.col("ts")) - micros(F.col("_clicked"))) / 1e6
    return found.select("event_id", "user_id", "click_id", F.round(seconds, 3).alias("seconds"))


def order_before_shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipped line with the customer's last order up to its shipping date."""
    base = sf_dir.rstrip("/")
    orders = spark.read.parquet(f"{base}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = spark.read.parquet(f"{base}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
    shipped = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    found = asof_join(
        shipped, orders, ["o_custkey"], "l_shipdate", "o_orderdate", {"o_orderkey": "last_orderkey"}, tie=["o_orderkey"]
    )
    return found.select("l_orderkey", "l_linenumber", "o_custkey", "last_orderkey")


def errors_after_click(spark: SparkSession, sf_dir: str, window_s: int) -> DataFrame:
    """Pairs of a click and an error of anyone no more than ``window_s`` seconds later."""
    events = _events(spark, sf_dir)
    at = micros(F.col("ts"))
    clicks = events.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), at.alias("clicked"))
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), at.alias("failed"))
    span = window_s * 1_000_000
    pairs = interval_join(
        clicks, errors, (F.col("clicked"), F.col("clicked") + span), (F.col("failed"), F.col("failed")),
        width=2.0 * span, least_width=1000.0,
    )
    return pairs.select("click_id", "error_id")


def hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and kind, counted by a stream over the event files and read when drained."""
    base = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{base}/events.parquet").schema
    # a stream's source is a folder or a pattern: this one matches the table's file or folder
    stream = event_stream(spark, f"{base}/events.parque[t]", schema)
    found = drained(windowed_counts(stream, "1 hour", "10 minutes"), "hourly")
    start = F.col("window_start").cast("bigint").alias("start_s")
    return found.select(start, "event_type", "n_events", "cents")


def user_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per kind and over all kinds, exact and from merged sketches.

    Sketches are stored per kind and day; days are merged to kinds and kinds to the total. A
    row tells whether the estimate lies within the sketch's stated error of the exact count.
    """
    events = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    t = RoundTables(spark, "sketches")
    try:
        stored, _ = t.write(sketched(events, ["event_type", "day"], "user_id"), "daily", row_count())
        t.drop_at_exit()
    except BaseException:
        t.drop()
        raise
    by_kind = merged(stored, ["event_type"])
    estimates = by_kind.unionByName(merged(by_kind, []).withColumn("event_type", F.lit("all kinds")))
    # one row per (kind, user) first: partial results shrink a hot user before the shuffle
    users = events.select("event_type", "user_id").distinct()
    exact = users.groupBy("event_type").agg(F.count("user_id").alias("n_users"))
    every = users.select("user_id").distinct().agg(F.count("user_id").alias("n_users"))
    exact = exact.unionByName(every.withColumn("event_type", F.lit("all kinds")))
    near = F.abs(F.col("estimate") - F.col("n_users")) <= relative_error() * F.col("n_users")
    return estimates.select("event_type", "n_rows", distinct_estimate().alias("estimate")).join(exact, "event_type").select(
        "event_type", "n_rows", "n_users", near.alias("within_error")
    )


def micros(ts: Column) -> Column:
    """A time as microseconds, exact as a double."""
    return F.unix_micros(ts.cast("timestamp"))

"""Drained streams against the batch function over the same files; late rows."""

from __future__ import annotations

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from routegraph.streaming import closed_windows, drained, event_stream, windowed_counts

SCHEMA = "ts timestamp, event_type string, value double"


def write(spark, folder, rows):
    df = spark.createDataFrame(rows, "s double, event_type string, value double")
    at = F.timestamp_seconds("s").alias("ts")
    df.select(at, "event_type", "value").coalesce(1).write.mode("append").parquet(str(folder))


def rows_of(df):
    return Counter((r["window_start"], r["event_type"], r["n_events"], r["cents"]) for r in df.collect())


def test_drained_micro_batches_equal_batch(spark, tmp_path):
    rng = random.Random(1)
    for part in range(4):  # each file a later stretch of time: nothing is late
        write(spark, tmp_path / "in", [(part * 7200.0 + rng.uniform(0, 7200), rng.choice("ab"), rng.randrange(500) / 100) for _ in range(80)])
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), batch.schema, files_per_batch=1)
    got = rows_of(drained(windowed_counts(stream, "30 minutes", "5 minutes")))
    counts = windowed_counts(batch, "30 minutes", "5 minutes")
    want = rows_of(closed_windows(counts, batch, "5 minutes"))
    assert got == want and 0 < len(got) < counts.count()  # the last windows are still open


def test_late_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    for part, rows in enumerate([[(60.0, "a", 1.0)], [(9000.0, "a", 1.0)], [(9100.0, "a", 1.0)], [(120.0, "a", 5.0), (20000.0, "b", 1.0)]]):
        before = set(folder.glob("*.parquet"))
        write(spark, folder, rows)
        (new,) = set(folder.glob("*.parquet")) - before
        os.utime(new, (1_000_000 + part, 1_000_000 + part))  # file sources take the oldest file first
    batch = spark.read.parquet(str(folder))
    stream = event_stream(spark, str(folder), batch.schema, files_per_batch=1)
    got = sorted(drained(windowed_counts(stream, "1 hour", "5 minutes")).collect(), key=lambda r: r["window_start"])
    assert [(r["event_type"], r["n_events"], r["cents"]) for r in got] == [("a", 1, 100), ("a", 2, 200)]


def test_no_events(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), none.schema)
    assert drained(windowed_counts(stream, "1 hour", "5 minutes")).collect() == []

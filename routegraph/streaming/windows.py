"""Windowed counts over a stream of events, the same function for batch and stream.

A stream reads files as they come, aggregates them per window and kind with state bounded by a
watermark, and emits a window once the watermark (the latest time seen, less ``late``) has
passed its end. A row is late if its window had ended by the watermark of the data that came
before the previous micro-batch; it is dropped and counted in no window. Without late rows,
what the drained stream has emitted equals ``closed_windows`` of the batch result over all
files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from routegraph.operators.lineage import RoundTables


def windowed_counts(events: DataFrame, width: str, late: str, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(window_start, window_end, kind, n_events, cents): batch or streaming ``events``.

    Values are summed as whole cents, exact in any order. Rows without a time are not counted.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(F.col(time), width)
    sums = timed.groupBy(window.alias("_window"), F.col(kind)).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")
    )
    return sums.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), kind, "n_events", "cents"
    )


def closed_windows(counts: DataFrame, events: DataFrame, late: str, time: str = "ts") -> DataFrame:
    """The windows of a batch result that a stream over the same events has emitted."""
    seen = events.agg(F.max(F.col(time).cast("timestamp")).alias("_seen"))
    mark = F.date_trunc("millisecond", F.col("_seen")) - F.expr(f"interval {late}")
    # one row
    return counts.join(F.broadcast(seen), F.col("window_end") <= mark).drop("_seen")


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files under ``path`` (a folder or a pattern) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drained(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Run a stream over all that is there now, and return what it has emitted.

    State and output lie under the checkpoint dir. The file sink's log names the files of
    batches that were committed, so a batch that is run again is not counted twice.
    """
    t = RoundTables(stream.sparkSession, name)
    try:
        query = (
            stream.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", t.path("state")).option("path", t.path("out"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        t.drop_at_exit()
        return t.read("out", stream.schema)
    except BaseException:
        t.drop()
        raise

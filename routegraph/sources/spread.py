"""Partitions by counted rows, for tables too large for the session's shuffle partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Rows a task sorts or groups at most (100 to 200 bytes each): more go to more partitions.
ROWS_PER_TASK = 1_000_000


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, rows: int, *keys: str, per_task: int | None = None) -> DataFrame:
    """``df``, dealt by ``keys`` to partitions of about ``per_task`` of its ``rows`` rows, if the
    session's shuffle partitions would be larger; a join or grouping by the keys keeps them."""
    parts = math.ceil(rows / (per_task or ROWS_PER_TASK))
    return df.repartition(parts, *keys) if parts > session_partitions(df.sparkSession) else df

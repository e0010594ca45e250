"""Stored sketches that merge upwards: approximate distinct counts and quantiles.

A sketch row is written once per fine group; any coarser question merges rows instead of
reading the data again, and new data only add rows. Sketches are Spark's own: HyperLogLog
for distinct values, KLL for quantiles. Building and merging are algebraic aggregates with
partial results, so a hot group is a sketch per task before the shuffle, of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets (as a power of two) of a distinct sketch, and the size parameter of a quantile sketch.
LG_BUCKETS, KLL_SIZE = 12, 200


def relative_error(lg_buckets: int = LG_BUCKETS, sigmas: float = 3.0) -> float:
    """Relative error of a distinct count that holds but for ``sigmas`` standard deviations."""
    return sigmas * 1.04 / math.sqrt(1 << lg_buckets)


def sketched(
    df: DataFrame, by: Sequence[str], distinct: str | None = None, quantile: str | None = None,
    lg_buckets: int = LG_BUCKETS, kll_size: int = KLL_SIZE,
) -> DataFrame:
    """(by..., n_rows[, distinct_sketch][, quantile_sketch]): one row per group, to be stored.

    Nulls enter no sketch; a group of nulls alone has an empty one.
    """
    parts = [F.count(F.lit(1)).alias("n_rows")]
    if distinct is not None:
        parts.append(F.hll_sketch_agg(F.col(distinct), lg_buckets).alias("distinct_sketch"))
    if quantile is not None:
        parts.append(F.kll_sketch_agg_double(F.col(quantile).cast("double"), kll_size).alias("quantile_sketch"))
    return df.groupBy(*by).agg(*parts)


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketch rows of coarser groups from stored rows (``by`` may be empty: one row)."""
    parts = [F.sum("n_rows").cast("bigint").alias("n_rows")]
    if "distinct_sketch" in sketches.columns:
        parts.append(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    if "quantile_sketch" in sketches.columns:
        parts.append(F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))
    return sketches.groupBy(*by).agg(*parts)


def distinct_estimate(sketch: str = "distinct_sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_estimate(q: float, sketch: str = "quantile_sketch") -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(q))

"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words and a schedule: its weight at equally spaced
knots of the training run, linear in between. The integral of the schedule, scaled to the
target, is the source's cumulative demand. The source's documents are laid end to end in a
fixed pseudo-random order, again for each repeat; where that stream's word number meets
the demand, inverting the integral gives the document's training position in [0, 1). The
placed documents are range-sorted by position.

A hot source is cut into buckets by the first hex digits of the order key; a document's
place is its bucket's offset plus a running sum inside the bucket, so no window holds a
source.

Defined results: a null text has no words; null sources form one source that comes last;
documents without words are never taken; an empty table gives no rows; rows alike in key
and text are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routegraph.llm.common import SPACE_WORD, bits_for, discard, owner, text_or_empty, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weight at the start, middle and end of training, cycling like WEIGHTS.
SCHEDULES = ((1.25, 1.0, 0.75), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def ranked(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``sizes`` with the rank of each source by code point, null last, from 0; the written
    table that it reads).

    Sources are range-partitioned by name, so a rank is the number of sources in earlier
    ranges, one number per partition, plus the place in the own one.
    """
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "mix-sources")
    counts = sorted(tuple(r) for r in ranged.groupBy("_part").agg(F.count(F.lit(1))).collect())
    earlier = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    # a row for each partition of the session, whatever the number of sources
    offsets = F.broadcast(sizes.sparkSession.createDataFrame(earlier, "_part int, _earlier long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("rank", place - 1).join(offsets, "_part").withColumn("rank", F.col("rank") + F.col("_earlier")), ranged


def targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """(_src, source, source_size, rank, target) from one row (_src, source, source_size) per source.

    The level at which least(repeats * size, level * weight) adds up to the demand: from the
    level without any limit, sources whose limit lies below it are taken as full and the
    level of the others is raised, until no more become full. Each step sums over the table of
    sources; the demand is concave in the level, so the steps are few.
    """
    named, ranged = ranked(sizes)
    s = written(
        named
        .withColumn("_w", F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * repeats)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .select("_src", "source", "source_size", "rank", "_w", "_cap", "_ratio"),
        "mix-ranked",
    )
    discard(ranged)
    whole = s.agg(F.sum("source_size"), F.sum("_w")).first()
    level, full = None, 0
    if whole[1]:
        demand = whole[0] * share
        level = demand / whole[1]
        while level is not None:
            below = F.col("_ratio") < level
            cap, open_, n = s.agg(
                F.sum(F.when(below, F.col("_cap"))), F.sum(F.when(~below, F.col("_w"))), F.count_if(below)
            ).first()
            if n == full:
                break
            full, level = n, (demand - (cap or 0.0)) / open_ if open_ else None
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), level * F.col("_w"))
    return s.select("_src", "source", "source_size", "rank", target.alias("target"))


def invert_demand(u: Column, rank: Column, schedules: Sequence[Sequence[float]]) -> Column:
    """The time at which the normalised integral of the source's schedule reaches ``u``."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        n = len(knots) - 1
        areas = [(a + b) / 2 for a, b in zip(knots, knots[1:])]
        total, at = sum(areas), F.lit(None).cast("double")
        below = [sum(areas[:i]) for i in range(n)]
        for i in range(n):
            v = u * total - below[i]
            a, b = (knots[i + 1] - knots[i]) / 2, knots[i]
            root = F.sqrt(F.greatest(F.lit(b * b) + 4 * a * v, F.lit(0.0)))
            t = (F.lit(float(i)) + F.coalesce(F.try_divide(2 * v, b + root), F.lit(0.0))) / n
            at = t if i == 0 else F.when(u * total >= below[i], t).otherwise(at)
        out = F.when(rank % len(schedules) == k, at).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


@owner
def place(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2,
    schedules: Sequence[Sequence[float]] = SCHEDULES, key: str = "doc_id", bucket_rows: int = 20_000,
) -> DataFrame:
    """(key, source, size, source_size, target, taken, positions, text_hash) for every row.

    ``positions`` has one training position per pass in which words of the row are taken;
    ``taken`` counts them, and the row at the end of a source's budget counts in part.
    """
    rows = written(
        docs.select(
            F.col(key).alias("_key"),
            F.col("source").cast("string").alias("_source"),
            F.regexp_count(text_or_empty(), F.lit(SPACE_WORD)).cast("long").alias("_size"),
            F.md5(F.encode(text_or_empty(), "UTF-8")).alias("_md5"),
            F.xxhash64(text_or_empty()).alias("_hash"),
        )
        .withColumn("_src", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("null")))
        .withColumn("_order", F.md5(F.concat_ws(":", F.col("_key").cast("string"), F.col("_md5")))),
        "mix-rows",
    )
    digits = -(-bits_for(rows.count(), bucket_rows, 7) // 4)
    rows = rows.withColumn("_bucket", F.substring("_order", 1, digits))
    buckets = written(
        rows.groupBy("_src", "_source", "_bucket").agg(F.sum("_size").alias("_sum")), "mix-buckets"
    )
    sizes = buckets.groupBy("_src").agg(
        F.first("_source").alias("source"), F.sum("_sum").alias("source_size")
    )
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .select("_src", "_bucket", "_offset")
        .join(targets(sizes, weights, share, repeats), "_src")
    )
    inside = Window.partitionBy("_src", "_bucket").orderBy("_order", "_key", "_size")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_offset") + F.col("_in") - F.col("_size")
    placed = (
        rows.withColumn("_in", F.sum("_size").over(upto))
        .join(offsets, ["_src", "_bucket"])
        .withColumn("_budget", F.round("target").cast("long"))
        .withColumn("_start", start)
        .withColumn("_full", F.when(F.col("source_size") > 0, F.expr("_budget div nullif(source_size, 0)")).otherwise(0))
        .withColumn("_rest", F.col("_budget") - F.col("_full") * F.col("source_size"))
        .withColumn("_part", F.least(F.greatest(F.col("_rest") - F.col("_start"), F.lit(0)), F.col("_size")))
        .withColumn("taken", F.col("_full") * F.col("_size") + F.col("_part"))
        .withColumn("_passes", F.col("_full") + F.when(F.col("_part") > 0, 1).otherwise(0))
    )

    def position(n: Column) -> Column:
        u = F.try_divide((n * F.col("source_size") + F.col("_start")).cast("double"), F.col("_budget").cast("double"))
        return F.round(invert_demand(u, F.col("rank"), schedules), 9)

    passes = [
        F.when((F.col("_size") > 0) & (F.col("_passes") > n), position(F.lit(n))) for n in range(repeats)
    ]
    return placed.withColumn("positions", F.array_compact(F.array(*passes))).select(
        F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size",
        F.round("target", 6).alias("target"), "taken", "positions",
        F.col("_hash").alias("text_hash"),
    )


def op3_mixing(docs: DataFrame) -> DataFrame:
    """The digest of the query, range-sorted by first training position (rows not taken last)."""
    first = F.try_element_at("positions", F.lit(1))
    return (
        place(docs)
        .select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
    1.5::DOUBLE * sum(source_size) OVER () AS total FROM w
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (
  SELECT source, source_size, rnk, least(cap, weight * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.rnk, t.target, round(t.target)::BIGINT AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p
), z AS (
  SELECT *, whole * size + least(greatest(budget - whole * source_size - begins, 0), size) AS taken,
    begins::DOUBLE / nullif(budget, 0)::DOUBLE AS u FROM q
), v AS (
  SELECT *, CASE rnk % 3
    WHEN 0 THEN CASE WHEN u * 2 >= 1.125
      THEN (1 + 2 * (u * 2 - 1.125) / (1.0 + sqrt(1.0 + 4 * (-0.125) * (u * 2 - 1.125)))) / 2
      ELSE 2 * (u * 2) / (1.25 + sqrt(1.5625 + 4 * (-0.125) * (u * 2))) / 2 END
    WHEN 1 THEN u
    ELSE CASE WHEN u * 2 >= 0.75
      THEN (1 + 2 * (u * 2 - 0.75) / (1.0 + sqrt(1.0 + 4 * 0.25 * (u * 2 - 0.75)))) / 2
      ELSE 2 * (u * 2) / (0.5 + sqrt(0.25 + 4 * 0.25 * (u * 2))) / 2 END END AS t FROM z
)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken::BIGINT AS taken,
  CASE WHEN size > 0 AND taken > 0 THEN round(least(greatest(t, 0), 1), 9) END AS position
FROM v
"""

"""Joins on time: as-of and interval joins that no hot key or crowded moment gathers in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from routegraph.operators.lineage import RoundTables, row_count

#: Rows behind a cell of the as-of join, and on one side of a bin of the interval join.
CELL_ROWS, BIN_ROWS = 1_000_000, 200_000


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, take: dict[str, str],
    tie: Sequence[str] = (), strict: bool = False, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``left`` with columns of the last row of ``right`` whose key is equal and whose time is not
    later (``strict``: earlier).

    ``take`` maps the names of right columns to their names in the result. Of right rows alike
    in key and time the one that is largest by ``tie``, then by the taken columns, counts. A
    null key or time matches nothing; the left row stays, with nulls.

    Right rows are first reduced to one per key and time, left rows to their distinct keys and
    times: only these thin rows are put in order. They are range-partitioned by key and time,
    so a hot key is cut into many cells; inside a cell a window carries the last fact forward,
    and what a cell begins without comes from the last fact of the key's earlier cells, one
    row per cell. The wide left rows move once, for the join with the answers.
    """
    keys = list(by)
    held = F.struct(*[F.col(c).alias(f"tie{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"take{i}") for i, c in enumerate(take)])
    known = right.filter(F.col(right_time).isNotNull()).dropna(subset=keys)
    facts = known.groupBy(*keys, F.col(right_time).alias("_time")).agg(F.max(held).alias("_fact"))
    points = left.select(*keys, F.col(left_time).alias("_time")).dropna()
    none = F.lit(None).cast(facts.schema["_fact"].dataType)
    line = facts.unionByName(points.select("*", none.alias("_fact"))).groupBy(*keys, "_time").agg(
        F.max("_fact").alias("_fact")
    )
    t = RoundTables(left.sparkSession, "asof")
    try:
        line, m = t.write(line, "line", row_count())
        least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = line.repartitionByRange(max(least, -(-m["n"] // cell_rows)), *keys, "_time")
        cells, _ = t.write(ranged.withColumn("_cell", F.spark_partition_id()), "cells", row_count())
        t.delete("line")
        upto = Window.partitionBy("_cell", *keys).orderBy("_time").rowsBetween(
            Window.unboundedPreceding, -1 if strict else Window.currentRow
        )
        inside = cells.withColumn("_last", F.last("_fact", ignorenulls=True).over(upto))
        ends = cells.groupBy(*keys, "_cell").agg(F.max_by("_fact", F.when(F.col("_fact").isNotNull(), F.col("_time"))).alias("_end"))
        earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier))
        carried = carried.filter("_carried IS NOT NULL").select(*keys, "_cell", "_carried")
        found = inside.join(carried, [*keys, "_cell"], "left").withColumn("_fact", F.coalesce("_last", "_carried"))
        answers = found.filter("_fact IS NOT NULL").select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_time",
            *[F.col(f"_fact.take{i}").alias(f"_take_{i}") for i in range(len(take))],
        )
        t.drop_at_exit()
    except BaseException:
        t.drop()
        raise
    on = F.col("_time") == left[left_time]
    for i, k in enumerate(keys):
        on = on & (F.col(f"_k{i}") == left[k])
    return left.join(answers, on, "left").select(
        *[left[c] for c in left.columns], *[F.col(f"_take_{i}").alias(a) for i, a in enumerate(take.values())]
    )


def interval_join(
    left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float,
    by: Sequence[str] = (), bin_rows: int = BIN_ROWS, least_width: float = 1.0,
) -> DataFrame:
    """All pairs of rows whose closed spans overlap (and whose ``by`` columns are equal).

    Spans are (first, last) numbers, for times such as ``F.unix_micros``; a span with a null or
    with its last before its first overlaps nothing. The columns of both sides must have
    different names but for ``by``.

    Both sides are dealt to the bins of ``width`` that their spans touch, joined bin by bin,
    and a pair is kept in the first bin its spans share, so none comes twice. Spans much longer
    than a bin would be copied to many: a span is dealt to bins wide enough that it touches few
    (each level four times as wide as the one below), and each pair of levels is joined in the
    wider one's bins. A bin that holds more than ``bin_rows`` rows on both sides is split into
    four, again and again down to ``least_width``; beyond that its rows really meet.
    """
    keys = list(by)

    def side(df: DataFrame, span: tuple[Column, Column], p: str) -> DataFrame:
        first, last = (c.cast("double") for c in span)
        out = df.select(F.struct(*[F.col(c) for c in df.columns]).alias(f"{p}_row"), *[F.col(k).alias(f"{p}_key_{k}") for k in keys],
                        first.alias(f"{p}_first"), last.alias(f"{p}_last"))
        out = out.filter(F.col(f"{p}_first") <= F.col(f"{p}_last"))
        long = F.greatest(F.col(f"{p}_last") - F.col(f"{p}_first"), F.lit(width)) / width
        return out.withColumn(f"{p}_level", F.ceil(F.log(4.0, long)).cast("int"))

    t = RoundTables(left.sparkSession, "interval")
    names = [f"{p}_{c}" for p in "lr" for c in ("row", "first", "last", *[f"key_{k}" for k in keys])]
    found: list[DataFrame] = []
    try:
        sides = {}
        levels = {}
        for p, df, span in (("l", left, left_span), ("r", right, right_span)):
            sides[p], m = t.write(side(df, span, p), p, [F.collect_set(f"{p}_level").alias("levels")])
            levels[p] = sorted(m["levels"])  # at most the logarithm of the longest span
        # by the level of the wider of the two: one pass per level, not one per pair of levels
        for level in sorted({*levels["l"], *levels["r"]}):
            wide = width * 4.0**level
            pairs = []
            for a, b in (("l", "r"), ("r", "l")):
                # rows of this level against those of it (once) and of all levels below
                below = F.col(f"{b}_level") <= level if a == "l" else F.col(f"{b}_level") < level
                pairs.append((sides[a].filter(F.col(f"{a}_level") == level), sides[b].filter(below)))
            for n, (one, other) in enumerate(pairs):
                found += _binned(t, f"{level}-{n}", one, other, wide, keys, names, bin_rows, least_width)
        t.drop_at_exit()
    except BaseException:
        t.drop()
        raise
    if not found:
        fields = [f for p in "lr" for f in sides[p].schema.fields if f.name in names]
        found = [left.sparkSession.createDataFrame([], StructType(fields))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    kept = [c for c in right.columns if c not in keys]
    return out.select(*[F.col(f"l_row.`{c}`").alias(c) for c in left.columns], *[F.col(f"r_row.`{c}`").alias(c) for c in kept])


def _binned(
    t: RoundTables, rel: str, one: DataFrame, other: DataFrame, width: float, keys: list[str], names: list[str],
    bin_rows: int, least_width: float,
) -> list[DataFrame]:
    """Overlapping pairs of ``one`` and ``other`` (prefixes l and r, in either order)."""
    p, q = one.columns[0][0], other.columns[0][0]

    def dealt(df: DataFrame, s: str, size: float) -> DataFrame:
        at = lambda c: F.floor(F.col(f"{s}_{c}") / size)
        return df.withColumn("_bin", F.explode(F.sequence(at("first"), at("last"))))

    def binned(df: DataFrame, s: str) -> DataFrame:
        return df.select("*", *[F.col(f"{s}_key_{k}").alias(f"_key_{k}") for k in keys])

    on = [*[f"_key_{k}" for k in keys], "_bin"]
    out = []
    a, b = dealt(binned(one, p), p, width), dealt(binned(other, q), q, width)
    depth = 0
    while True:
        crowded = None
        if width / 4 >= least_width:
            sums = [df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"_n{i}")) for i, df in enumerate((a, b))]
            both = sums[0].join(sums[1], on).filter((F.col("_n0") > bin_rows) & (F.col("_n1") > bin_rows)).select(*on)
            crowded, m = t.write(both, f"crowded-{rel}-{depth}", row_count())
            if not m["n"]:
                crowded = None
        calm_a, calm_b = (a, b) if crowded is None else (x.join(crowded, on, "left_anti") for x in (a, b))
        first_shared = F.greatest(F.floor(F.col("l_first") / width), F.floor(F.col("r_first") / width))
        overlap = (F.col("l_first") <= F.col("r_last")) & (F.col("r_first") <= F.col("l_last"))
        out.append(calm_a.join(calm_b, on).filter(overlap & (F.col("_bin") == first_shared)).select(*names))
        if crowded is None:
            return out
        # a quarter of a crowded bin each; a pair stays in the crowded bin that holds its first shared point
        width, depth = width / 4, depth + 1
        split = []
        for i, (df, s) in enumerate(((a, p), (b, q))):
            rows = df.join(crowded, on, "left_semi")
            inside = [F.greatest(F.floor(F.col(f"{s}_first") / width), F.col("_bin") * 4), F.least(F.floor(F.col(f"{s}_last") / width), F.col("_bin") * 4 + 3)]
            split.append(t.write(rows.withColumn("_bin", F.explode(F.sequence(*[c.cast("long") for c in inside]))), f"split-{rel}-{depth}-{i}", row_count())[0])
        a, b = split

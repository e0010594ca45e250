"""As-of and interval joins against brute force, with hot keys and crowded moments."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from routegraph.operators import asof_join, interval_join


def timed(seed, n, hot):
    """Rows (id, key, time) with ties and nulls; half of them with one key if ``hot``."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if hot and rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        rows.append((i, key, rng.randrange(n // 3) if rng.random() < 0.97 else None))
    return rows


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("cell_rows", [1_000_000, 20])
def test_asof_join(spark, strict, cell_rows):
    left, right = timed(1, 400, True), timed(2, 300, True)
    a = spark.createDataFrame(left, "id int, k string, t int").repartition(5)
    b = spark.createDataFrame([(*r, f"v{r[0] % 7}") for r in right], "rid int, k string, at int, v string").repartition(5)
    got = asof_join(a, b, ["k"], "t", "at", {"v": "value", "rid": "found"}, tie=["rid"], strict=strict, cell_rows=cell_rows)
    assert got.columns == ["id", "k", "t", "value", "found"]
    want = []
    for i, k, t in left:
        ok = [(at, rid) for rid, key, at in right if k is not None and key == k and None not in (t, at) and (at < t if strict else at <= t)]
        rid = max(ok)[1] if ok else None
        want.append((i, k, t, None if rid is None else f"v{rid % 7}", rid))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_asof_join_cuts_a_hot_key(spark):
    n = 4000
    a = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    b = spark.range(0, n, 1000).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = asof_join(a, b, ["k"], "t", "t", {"v": "v"}, cell_rows=100)
    assert got.filter("v != floor(t / 1000) * 1000").count() == 0 and got.count() == n


def test_asof_join_without_rows(spark):
    a = spark.createDataFrame([(1, "k", 3)], "id int, k string, t int")
    none = a.limit(0).select("k", F.col("t").alias("at"), F.col("id").alias("v"))
    assert [tuple(r) for r in asof_join(a, none, ["k"], "t", "at", {"v": "v"}).collect()] == [(1, "k", 3, None)]
    assert asof_join(a.limit(0), none, ["k"], "t", "at", {"v": "v"}).collect() == []


def spans(seed, n, longest, crowded):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        first = rng.uniform(490, 510) if crowded and i % 2 else rng.uniform(-1000, 1000)
        length = rng.choice([0, 0, rng.uniform(0, 5), rng.uniform(0, longest)])
        out.append((i, rng.choice("xy"), None if i % 41 == 0 else first, first + length if i % 37 else first - 1))
    return out


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("bin_rows,crowded", [(200_000, False), (5, True)])
def test_interval_join(spark, by, bin_rows, crowded):
    left, right = spans(3, 150, 900, crowded), spans(4, 120, 60, crowded)
    left[0:1] = [(0, "x", -5000.0, 5000.0)]
    a = spark.createDataFrame(left, "id int, k string, s double, e double").repartition(3)
    b = spark.createDataFrame(right, "rid int, k string, s2 double, e2 double").repartition(3)
    b = b if by else b.withColumnRenamed("k", "k2")
    got = interval_join(a, b, (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")), 10.0, by, bin_rows, 0.5)
    want = Counter(
        (i, j)
        for i, k, s, e in left
        for j, m, s2, e2 in right
        if None not in (s, s2) and s <= e and s2 <= e2 and s <= e2 and s2 <= e and (not by or k == m)
    )
    rows = got.collect()
    assert Counter((r["id"], r["rid"]) for r in rows) == want and len(rows) > 100
    assert got.columns == ["id", "k", "s", "e", "rid", *([] if by else ["k2"]), "s2", "e2"]


def test_interval_join_without_rows(spark):
    a = spark.createDataFrame([], "id int, s double")
    b = spark.createDataFrame([(1, 2.0)], "rid int, t double")
    for x, y in ((a, b.limit(0)), (a, b)):
        assert interval_join(x, y, (F.col("s"), F.col("s")), (F.col("t"), F.col("t")), 1.0).collect() == []

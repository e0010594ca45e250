"""Stored sketches against exact answers, merged upwards in any grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from routegraph.operators import sketches as S


def test_merged_sketches_stay_within_their_error(spark, tmp_path):
    rows = spark.range(60_000).select(
        (F.col("id") % 5).alias("region"), (F.col("id") % 40).alias("shop"),
        (F.xxhash64("id") % 7000).alias("visitor"), (F.col("id") % 1000).cast("double").alias("paid"),
    )
    S.sketched(rows, ["region", "shop"], "visitor", "paid").write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    assert stored.count() == 40
    for by in ([], ["region"], ["region", "shop"]):
        got = S.merged(stored, by).select(*by, "n_rows", S.distinct_estimate().alias("n"), S.quantile_estimate(0.5).alias("middle"))
        exact = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("visitor").alias("d"), F.percentile("paid", 0.5).alias("p"))
        pairs = got.join(exact, by) if by else got.crossJoin(exact)
        for r in pairs.collect():
            assert r["n_rows"] == r["rows"]
            assert abs(r["n"] - r["d"]) <= S.relative_error() * r["d"]
            assert abs(r["middle"] - r["p"]) <= 0.03 * 1000


def test_empty_and_null_groups(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 1, 2.0)], "k string, v int, x double")
    s = S.sketched(df, ["k"], "v", "x")
    got = {r["k"]: r["n"] for r in s.select("k", S.distinct_estimate().alias("n")).collect()}
    assert got == {"a": 0, "b": 1}
    assert S.merged(s, []).select(S.distinct_estimate().alias("n")).first()["n"] == 1
    assert S.sketched(df.limit(0), ["k"], "v").count() == 0

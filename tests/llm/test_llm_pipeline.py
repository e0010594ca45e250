"""The pipeline, stage by stage, against brute-force versions of every stage."""

from __future__ import annotations

from collections import Counter

import brute
from pyspark.sql import functions as F

import corpus_pipeline as P
from routegraph.llm.langid import op5_language_id
from routegraph.llm.mixing import place


def test_stages(spark, corpus, tmp_path):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = (before, docs)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns

    def told(df):
        return [r.asDict() for r in df.select("doc_id", "text", "lang", "source").collect()]

    def listed(rows):
        return Counter((r["doc_id"], r["text"]) for r in rows)

    before, after = kept["language ID"]
    rejected = {r["doc_id"] for r in op5_language_id(before).filter("rejected").collect()}
    assert {100, 101, 102, 103} <= rejected
    assert {r["doc_id"] for r in told(before)} - {r["doc_id"] for r in told(after)} <= rejected

    before, after = kept["n-gram Jaccard join"]
    rows = told(before)
    groups = brute.components(rows)
    full = {g[3] for g in groups if g[0]}
    assert sum(listed(told(after)).values()) == len(full) + sum(not g[0] for g in groups)
    lows = Counter(g[1] for g in {(g[3], g[1]) + (0,): g for g in groups if g[0]}.values())
    have = Counter(r["doc_id"] for r, g in zip(told(after), brute.components(told(after)), strict=True) if g[0])
    assert have == lows
    assert all(g[2] == 0 for g in brute.components(told(after)) if g[0])

    before, after = kept["benchmark decontamination"]
    rows = told(before)
    clean = [r for r, c in zip(rows, brute.contamination(rows, corpus[2]), strict=True) if not c[4]]
    assert listed(told(after)) == listed(clean) and len(clean) < len(rows)

    before, after = kept["mixing sources to target weights"]
    passes = {(r["doc_id"], r["n"]): r["p"] for r in place(before).select("doc_id", F.col("size").alias("n"), F.size("positions").alias("p")).collect()}
    want = Counter()
    for r in told(before):
        want[r["doc_id"], r["text"]] += passes[r["doc_id"], len(brute.space_words(r["text"]))]
    assert listed(told(after)) == +want

    before, after = kept["sharding"]
    sizes = Counter(r["shard"] for r in after.collect())
    assert after.count() == before.count() and max(sizes.values()) - min(sizes.values()) <= 1


def test_run_on_empty_tables(spark, empty):
    assert P.run(spark, empty).collect() == []


def test_repeated_rows_in_every_stage(spark, corpus):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (2, "", "en", "s"), (2, "", "en", "s"), (3, None, None, None)],
        "doc_id long, text string, lang string, source string",
    )
    joined = P.near_duplicates(spark, docs, corpus[0])
    assert Counter(r["doc_id"] for r in joined.collect()) == {1: 1, 2: 2, 3: 1}
    assert P.decontaminated(spark, docs, corpus[0]).count() == 5
    mixed = P.mixed(spark, docs, corpus[0])
    assert {r["doc_id"] for r in mixed.collect()} == {1} and 2 <= mixed.count() <= 4
    assert P.sharded(spark, docs, corpus[0]).count() == 5

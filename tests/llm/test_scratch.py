"""After a query only the tables its result reads remain; after a failure none."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routegraph.llm import common, links
from routegraph.llm.queries import QUERIES
from routegraph.session import ensure_checkpoint_dir


def tables(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(root)}


#: Tables that the result of a query reads, by the start of their names.
READ = {
    "op1_sharding": {"shard-rows", "shard-cells"},
    "op2_ngram_join": {"join-rows", "join-nodes"},
    "op3_mixing": {"mix-rows", "mix-buckets", "mix-ranked"},
    "op4_license_scan": {"license-index"},
    "op5_language_id": set(),
    "op6_decontaminate": {"bench-windows", "text-prints", "text-hits"},
    "op7_lm_scoring": set(),
    "op8_exact_dedup": {"dedup-rows", "dedup-groups"},
    "op9_suffix_dedup": set(),
    "op10_secret_scan": {"secret-candidates", "secret-spread"},
    "op11_conversation_repair": set(),
    "op12_spelling": {"routegraph-spelling", "routegraph-words"},
    "op13_warc": {"routegraph-warc"},
}


def kinds(names):
    return {"-".join(n.split("-")[:2]) for n in names}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_tables_left_by_a_query(spark, corpus, name):
    before = tables(spark)
    df = QUERIES[name](spark, corpus[0])
    left = kinds(tables(spark) - before)
    assert left == READ[name]
    assert df.count() >= 0


def test_pipeline_keeps_its_last_tables(spark, corpus):
    before = tables(spark)
    df = corpus_pipeline.run(spark, corpus[0])
    assert kinds(tables(spark) - before) == {"stage-mixing", "shard-rows", "shard-cells"}
    assert df.count() > 0


def test_failure_leaves_nothing(spark, monkeypatch):
    before = tables(spark)

    def broken(_):
        raise RuntimeError("lost")

    monkeypatch.setattr(links, "_small_star", broken)
    with pytest.raises(RuntimeError):
        links.stars(spark.range(9).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert tables(spark) == before


def test_blocks_hand_their_tables_on(spark):
    before = tables(spark)
    with common.Scratch() as outer:
        with common.Scratch():
            one = common.written(spark.range(3), "one")
            two = common.written(spark.range(4), "two")
        common.discard(two)
        assert kinds(tables(spark) - before) == {kinds([os.path.basename(one.scratch_path)]).pop()}
        three = common.written(spark.range(5), "three")
        outer.only(three)
    assert len(tables(spark) - before) == 1 and three.count() == 5
    with pytest.raises(ZeroDivisionError), common.Scratch():
        common.written(spark.range(3), "four")
        raise ZeroDivisionError
    assert len(tables(spark) - before) == 1

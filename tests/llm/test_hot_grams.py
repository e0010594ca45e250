"""A passage in a third of all documents: links stay whole and no group grows with it."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from routegraph.llm import ngram_join


def corpus_with_passage(rng, n):
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(3, 25)))
        if i % 3 == 0:
            text = f"{text} {passage}" if i % 2 else passage + " " + " ".join(rng.choices(words, k=rng.randrange(6)))
        rows.append({"doc_id": i, "text": text})
    return rows


@pytest.mark.parametrize("hot", ["sample", "all", "none"])
def test_links_are_whole_whatever_counts_as_common(spark, monkeypatch, hot):
    rng = random.Random(7)
    rows = corpus_with_passage(rng, 150)
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(5)
    if hot == "sample":
        monkeypatch.setattr(ngram_join, "SAMPLE_OF", 2)
        found = ngram_join.common_grams(docs.select(F.col("doc_id").alias("_key"), F.lit(0).alias("_hash"), F.col("text").alias("_text")), 150)
        assert 20 <= len(found) <= 40  # the passage's grams
    elif hot == "all":
        every = np.unique(np.concatenate([ngram_join.gram_sets([r["text"].encode()])[0] for r in rows]))
        # only grams of more than one class may be left uncounted
        owners = {}
        for r in rows:
            flat, _, cls = ngram_join.gram_sets([r["text"].encode()])
            for g in flat.tolist():
                owners.setdefault(g, set()).add(int(cls[0]))
        shared = np.array([g for g in every.tolist() if len(owners[g]) > 1], np.uint64)
        monkeypatch.setattr(ngram_join, "common_grams", lambda *_: shared)
    else:
        monkeypatch.setattr(ngram_join, "common_grams", lambda *_: np.zeros(0, np.uint64))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.similar_texts(docs, tile=16).collect()}
    want = brute.components(rows)
    assert got == {r["doc_id"]: w[:3] for r, w in zip(rows, want, strict=True)}
    assert sum(w[2] for w in want) > 50


def test_a_common_passage_gives_a_bucket_a_few_entries_per_chunk(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 1 << 14)
    monkeypatch.setattr(ngram_join, "SAMPLE_OF", 4)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    passage = " ".join(rng.choices(words, k=40))
    rows = [(i, passage + " " + " ".join(rng.choices(words, k=5)) if i % 3 == 0 else " ".join(rng.choices(words, k=30))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    body = docs.select(F.col("doc_id").alias("_key"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
    hot = ngram_join.common_grams(body, 6000)
    assert len(hot) >= 30
    chunks = -(-sum(len(t) for _, t in rows) // (1 << 14)) + 4

    def entries(blobs, name):
        return max(
            sum(len(x[name]) for x in map(ngram_join.unpack, (r["data"] for r in group)))
            for group in _by_bucket(blobs).values()
        )

    plain = entries(ngram_join.gram_blobs(body, 16, 1.0, np.zeros(0, np.uint64)).filter("not about"), "doc")
    counted = entries(ngram_join.gram_blobs(body, 16, 1.0, hot).filter("not about"), "doc")
    assert counted < plain - 2000
    kept = ngram_join.candidate_grams(ngram_join.gram_blobs(body, 16, 1.0, hot), 16)
    sent = entries(kept.filter("bucket >= 0"), "gram")
    assert sent < 60 * chunks  # not the 2000 classes of each of the passage's grams


def _by_bucket(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["bucket"], []).append(r)
    return out

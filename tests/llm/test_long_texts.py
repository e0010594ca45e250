"""Texts of tens of megabytes, and texts cut into pieces, through the operators."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from routegraph.llm import exact_dedup, secret_scan
from routegraph.llm.kn_scoring import op7_lm_scoring
from routegraph.llm.ngram_join import op2_ngram_join
from routegraph.llm.spelling import op12_spelling
from routegraph.llm.suffix_dedup import op9_suffix_dedup

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("piece", [7, 100, 1 << 22])
def test_pieces_give_the_fingerprints_of_whole_texts(spark, piece):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é\n\t", k=rng.randrange(400))) for _ in range(40)]
    texts += [t + " " for t in texts[:15]] + [None, "", " \n" * 60, "é" * 300, "é" * 299 + "e"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r["_key"]: r for r in exact_dedup.fingerprints(docs, "doc_id", "text", size=16, piece=piece).collect()}
    for i, t in enumerate(texts):
        clean = (t or "").encode().translate(None, exact_dedup.SPACES)
        assert (got[i]["_len"], got[i]["_h1"], got[i]["_h2"]) == (len(clean), *exact_dedup.fingerprint(clean, size=16))
        assert bytes(got[i]["_sha"]) == hashlib.sha256(clean).digest() and got[i]["_chars"] == len(t or "")
    copies = exact_dedup.exact_copies(docs, size=16, piece=piece).collect()
    assert len(copies) == len(texts)
    for r in copies:
        clean = "".join((texts[r["doc_id"]] or "").split())
        assert r["group_size"] == sum("".join((t or "").split()) == clean for t in texts)


@pytest.fixture(scope="module")
def large(spark):
    """One text of 24 MB, a copy of it with one more word, and some short ones."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=4_000_000))
    rows = [(1, long, "s"), (2, long + " tail", "s"), (3, "short text here", "t"), (4, None, None)]
    return spark.createDataFrame(rows, DOCS), long


def test_texts_of_tens_of_megabytes(large):
    docs, long = large
    assert len(long) > 20 << 20
    got = {r["doc_id"]: r for r in exact_dedup.op8_exact_dedup(docs).collect()}
    assert got[1]["text_sha256"] == hashlib.sha256(long.replace(" ", "").encode()).hexdigest() and got[1]["kept"]
    joined = {r["doc_id"]: r["component_id"] for r in op2_ngram_join(docs).collect()}
    assert joined == {1: 1, 2: 1, 3: 3, 4: 4}
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in op9_suffix_dedup(docs).collect()}
    assert cut[1][0] == len(long) and cut[2] == (len(long) + 5, len(long))
    tokens = {r["doc_id"]: r["n_tokens"] for r in op7_lm_scoring(docs).collect()}
    assert tokens == {1: 4_000_001, 2: 4_000_002, 3: 4, 4: 1}
    secrets = {r["doc_id"]: r["n_assign"] for r in secret_scan.op10_secret_scan(docs).collect()}
    assert secrets == {1: 0, 2: 0, 3: 0, 4: 0}
    assert op12_spelling(docs.withColumn("doc_id", F.col("doc_id"))).agg(F.sum("n")).first()[0] > 2_000_000


def test_only_texts_shorter_than_a_string(spark):
    rows = [(i, "short " * (i % 8), "s") for i in range(40)] + [(50, "x" * 60, "s"), (51, "x" * 60, "s")]
    for part in (rows, rows[:40]):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in op9_suffix_dedup(spark.createDataFrame(part, DOCS)).collect()}
        assert got == {i: (len(t), 60 if i == 51 else 0) for i, t, _ in part}

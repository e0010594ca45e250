"""Training-corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``. A stage's decisions are joined back to the
documents by key and text hash, so rows with the same key and different texts are told
apart and rows with null keys take part. Columns that a stage adds meanwhile have names that
``docs`` does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegraph.llm.common import Scratch, benchmark, discard, documents, text_or_empty, written
from routegraph.llm.decontaminate import contamination, judged
from routegraph.llm.langid import learnt, predict
from routegraph.llm.mixing import place
from routegraph.llm.ngram_join import similar_texts
from routegraph.llm.sharding import op1_sharding


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``docs`` has columns of these names."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for i in range(len(taken) + 1) if (n := f"_stage_{name}{'_' * i}") not in taken) for name in names]


def _same(docs: DataFrame, key: str, hash_: str) -> Column:
    """Join condition between documents and decisions with columns ``key`` and ``hash_``."""
    return docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(text_or_empty()) == F.col(hash_))


def _one_each(docs: DataFrame, copies: DataFrame, key: str, hash_: str) -> DataFrame:
    """``docs`` with one row per key and text, if ``copies`` (key, hash_) has repeated rows."""
    if copies.groupBy(key, hash_).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs
    columns = docs.columns
    return docs.withColumn(hash_, F.xxhash64(text_or_empty())).dropDuplicates(["doc_id", hash_]).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the models recognise a language; rejected ones go."""
    names = _free(docs, "lang", "score", "entropy", "rejected")
    told = predict(docs, learnt(docs), "text", docs.columns, tuple(names))
    return told.filter(~F.col(names[3])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest key, of every group of linked texts."""
    key, hash_ = _free(docs, "key", "hash")
    with Scratch() as scope:
        found = written(similar_texts(docs), "stage-join")
        scope.only(found)
    found = found.filter("stays").select(F.col("doc_id").alias(key), F.col("text_hash").alias(hash_), "n_shingles")
    grouped = found.filter("n_shingles > 0")
    alone = docs.filter(~F.regexp_like(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]")))
    kept = docs.join(grouped.select(key, hash_).distinct(), _same(docs, key, hash_), "left_semi")
    return _one_each(kept, grouped, key, hash_).unionByName(alone)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    key, hash_ = _free(docs, "key", "hash")
    with Scratch() as scope:
        hit = judged(contamination(docs, benchmark(spark, sf_dir))).filter("contaminated")
        hit = written(hit.select(F.col("_key").alias(key), F.col("_hash").alias(hash_)).distinct(), "stage-hits")
        scope.only(hit)
    return docs.join(hit, _same(docs, key, hash_), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: every document as often as the mix takes it, range-sorted by
    training position. The document at the end of a source's budget stays whole."""
    key, hash_, position = _free(docs, "key", "hash", "position")
    with Scratch() as scope:
        places = written(place(docs), "stage-mix")
        scope.only(places)
    places = places.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hash_), "positions")
    # a row for each position: rows alike in key and text never meet in one array
    taken = places.select(key, hash_, F.explode("positions").alias(position))
    one = _one_each(docs, places, key, hash_)
    return one.join(taken, _same(one, key, hash_)).orderBy(position, "doc_id").select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the stream."""
    return op1_sharding(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]
#: Language models cannot be written in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with Scratch() as scope:
            docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
            scope.only(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

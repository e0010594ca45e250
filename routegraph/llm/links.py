"""Connected components of a link table, for near-duplicate groups.

Links are first contracted inside every task (union-find over its own links), then large-
star and small-star rounds run until the links form stars around each component's smallest
node. Both sides of every join in a round are plain scans, so that Spark can split a node
that has very many links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.llm.common import Scratch, discard, written


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node connected with each through the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(nxt := new[new], new):
            new = nxt
        if np.array_equal(new, label):
            return label
        label = new


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) with a > b that connect the same nodes, fewer of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            top = roots(len(nodes), at[: len(a)], at[len(a) :])
            out = np.flatnonzero(top != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[top[out]])], names=["a", "b"])

    return links.select("a", "b").mapInArrow(scan, "a long, b long")


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links after the step, the table of minima they read)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "star-least")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "star-least")
    moved = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), least


def stars(links: DataFrame) -> DataFrame:
    """(a, b): every node that is not its component's smallest, with that smallest node."""
    state = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).alias("s")

    def step(star, of: DataFrame) -> DataFrame:
        out, least = star(of)
        out = written(out, "stars")
        discard(least)
        return out

    with Scratch() as scope:
        now = written(contracted(links.filter("a != b")).distinct(), "stars")
        mark = now.select(state).first()["s"]
        while mark["n"]:
            large = step(_large_star, now)
            new = step(_small_star, large)
            discard(large)
            fresh = new.select(state).first()["s"]
            if fresh == mark:
                break
            discard(now)
            now, mark = new, fresh
        scope.only(now)
    return now

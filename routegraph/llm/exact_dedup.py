"""Exact deduplication with composable polynomial fingerprints.

The fingerprint of a text is a polynomial in its bytes modulo two primes, with its length.
Chunks are hashed on their own and combined: hash(xy) = hash(x) * base^len(y) + hash(y),
so a huge document is hashed in parallel: a text of more than ``PIECE`` characters is cut into
rows of that size, which tasks hash on their own, and their hashes are combined in order.
Texts with equal fingerprints are then compared chunk by chunk: for every fingerprint and chunk number the
smallest and the largest chunk are aggregated (partial results before the shuffle, so a
group of copies never meets in one task) and must be the same. Where they differ, the
fingerprint collided and its texts are told apart by their SHA-256.

Defined results: a null text is an empty text; empty texts equal each other; of rows alike
in length and key one stays; null keys come after all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.llm.common import discard, owner, written

SPACES = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 16
#: Characters from which on a text is cut into rows.
PIECE = 1 << 22
#: Two primes under 2^31 and a base for each: products of a power and a byte, summed over
#: a chunk, stay under 2^64.
MODULI = ((2147483647, 911382323), (2147483629, 972663749))


@cache
def _powers(prime: int, base: int, n: int) -> np.ndarray:
    """base^(n-1), ..., base, 1 modulo prime."""
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % prime
    return out


def chunk_hash(chunk: bytes, moduli=MODULI, size: int = CHUNK) -> tuple[int, ...]:
    b = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(b)
    return tuple(int((b * _powers(p, r, size)[size - n :]).sum() % np.uint64(p)) if n else 0 for p, r in moduli)


def combine(left: tuple[int, ...], right: tuple[int, ...], right_len: int, moduli=MODULI) -> tuple[int, ...]:
    """The hash of a text from those of its two parts."""
    return tuple(
        (x * pow(r, right_len, p) + y) % p for x, y, (p, r) in zip(left, right, moduli, strict=True)
    )


def fingerprint(data: bytes, moduli=MODULI, size: int = CHUNK) -> tuple[int, ...]:
    out = (0,) * len(moduli)
    for at in range(0, len(data), size):
        part = data[at : at + size]
        out = combine(out, chunk_hash(part, moduli, size), len(part), moduli)
    return out


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [(x or b"").translate(None, SPACES) for x in column.to_pylist()]


def _hashed(texts: DataFrame, moduli, size: int) -> DataFrame:
    """The columns of ``texts`` but the last, its text, with _len, _h1, _h2 and _sha."""
    *keep, body = texts.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = _texts(batch, body)
            prints = [fingerprint(t, moduli, size) for t in cleaned]
            numbers = [[len(t) for t in cleaned], [p[0] for p in prints], [p[1] for p in prints]]
            shas = pa.array([hashlib.sha256(t).digest() for t in cleaned], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(n, pa.int64()) for n in numbers], shas], names=[*keep, "_len", "_h1", "_h2", "_sha"]
            )

    old = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.mapInArrow(scan, f"{old}, _len long, _h1 long, _h2 long, _sha binary")


def pieces(docs: DataFrame, text: str, moduli=MODULI, size: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """(_id, _len, _h1, _h2): the fingerprint of every different text of more than ``piece`` characters.

    Texts go by their SHA-256 here; texts that have the same are cut once.
    """
    long = docs.filter(F.length(text) > piece).select(F.sha2(F.col(text).cast("binary"), 256).alias("_id"), F.col(text).alias("_text"))
    last = F.floor((F.length("_text") - 1) / piece).cast("int")
    cut = long.select("_id", "_text", F.explode(F.sequence(F.lit(0), last)).alias("_no")).select(
        "_id", "_no", F.substring("_text", F.col("_no") * piece + 1, F.lit(piece)).alias("_piece")
    )
    hashed = _hashed(cut.dropDuplicates(["_id", "_no"]), moduli, size)
    # a text has no more pieces than 2^31 bytes give: a few hundred numbers
    parts = hashed.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_no", "_len", "_h1", "_h2"))).alias("_parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, total = (0,) * len(moduli), 0
                for p in found:
                    out = combine(out, (p["_h1"], p["_h2"]), p["_len"], moduli)
                    total += p["_len"]
                rows.append((name, total, *out))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_id", "_len", "_h1", "_h2"])

    return parts.mapInArrow(join, "_id string, _len long, _h1 long, _h2 long")


def fingerprints(docs: DataFrame, key: str, text: str, moduli=MODULI, size: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """(_key, _chars, _len, _h1, _h2, _sha) for every row; _sha is the SHA-256 of the text without spaces."""
    chars = F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_chars")
    short = docs.filter(F.coalesce(F.length(text), F.lit(0)) <= piece)
    out = _hashed(short.select(F.col(key).alias("_key"), chars, F.col(text).alias("_text")), moduli, size)
    found = written(pieces(docs, text, moduli, size, piece), "dedup-long")
    if found.isEmpty():
        discard(found)
        return out
    clean = F.translate(F.col(text), SPACES.decode(), "")
    long = docs.filter(F.length(text) > piece).select(
        F.col(key).alias("_key"), chars, F.unhex(F.sha2(clean.cast("binary"), 256)).alias("_sha"),
        F.sha2(F.col(text).cast("binary"), 256).alias("_id"),
    )
    return out.unionByName(long.join(found, "_id").drop("_id"))


def chunks(docs: DataFrame, text: str, moduli=MODULI, size: int = CHUNK) -> DataFrame:
    """(_len, _h1, _h2, _no, _bytes): every chunk of every text with the text's fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_len", "_h1", "_h2", "_no", "_bytes"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for t in _texts(batch, "_text"):
                p = fingerprint(t, moduli, size)
                rows += [(len(t), *p, i, t[at : at + size]) for i, at in enumerate(range(0, len(t), size))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col(text).alias("_text")).mapInArrow(
        scan, "_len long, _h1 long, _h2 long, _no int, _bytes binary"
    )


@owner
def exact_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", moduli=MODULI, size: int = CHUNK, piece: int = PIECE
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    print_of = ["_len", "_h1", "_h2"]
    rows = written(
        fingerprints(docs, key, text, moduli, size, piece).withColumn("_row", F.monotonically_increasing_id()),
        "dedup-rows",
    )
    first = F.min(F.struct(-F.col("_chars"), F.col("_key").isNull(), F.col("_key"), F.col("_row")))

    def grouped(group: list[str]) -> DataFrame:
        sums = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"), first.alias("_first"))
        keep = [F.col("_first._key").alias("keep_id"), F.col("_first._row").alias("_kept")]
        return written(sums.select(*group, "group_size", *keep), "dedup-groups")

    # rows and groups are both written tables, so that a hot group's side of a join is one
    # plain exchange, which Spark can split
    group = print_of
    groups = grouped(group)
    members = rows.join(groups.filter("group_size > 1"), group, "left_semi")
    sharing = members.select(F.col("_key").alias("_member")).distinct()
    again = docs.select(key, text).join(sharing, F.col(key).eqNullSafe(F.col("_member")), "left_semi")
    compared = (
        chunks(again, text, moduli, size)
        .groupBy(*print_of, "_no")
        .agg(F.min("_bytes").alias("_least"), F.max("_bytes").alias("_most"))
    )
    collided = written(compared.filter("_least != _most").select(*print_of).distinct(), "dedup-collided")
    if not collided.isEmpty():
        told = F.when(F.col("_hit"), F.col("_sha")).otherwise(F.lit(b"")).alias("_told")
        marked = rows.join(collided.withColumn("_hit", F.lit(True)), print_of, "left")
        before = rows, groups
        rows = written(marked.select("*", told).drop("_hit"), "dedup-told")
        group = [*print_of, "_told"]
        groups = grouped(group)
        discard(*before)
    discard(collided)
    return rows.join(groups, group).select(
        F.col("_key").alias(key),
        "keep_id",
        "group_size",
        (F.col("_row") == F.col("_kept")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def op8_exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_copies(docs)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

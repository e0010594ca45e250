"""Packed exchanges: arrays instead of rows between tasks.

Operators that handle every word or byte position would need a row for each. Instead, a
task packs the entries for one bucket into one compressed row of arrays; Spark shuffles
the rows by bucket and hands each bucket, a bounded share of all entries, to one call.
The number of buckets follows the size of the input, and the bucket of an entry comes from
its hash.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "bucket int, chunk long, data binary"
#: Bytes of text behind one bucket.
BUCKET_BYTES = 12 << 20


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays, each with its kind and length before its bytes, compressed."""
    parts = []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        parts += [struct.pack("<B2sI", len(name), a.dtype.str[1:].encode(), len(a)), name.encode(), a.tobytes()]
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(b"".join(parts))


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as the smallest unsigned kind that holds their maximum."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, {}
    while at < len(raw):
        size, kind, n = struct.unpack_from("<B2sI", raw, at)
        at += 7
        name, dtype = raw[at : at + size].decode(), np.dtype(kind.decode())
        out[name] = np.frombuffer(raw, dtype, n, at + size)
        at += size + n * dtype.itemsize
    return out


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def buckets_for(df: DataFrame, size: int, bytes_each: int = BUCKET_BYTES) -> int:
    """Buckets for ``size`` bytes of text, and no fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // bytes_each))


def split(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The entries of every bucket that has any, in their order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    sorted_arrays = [a[order] for a in arrays]
    for b in np.flatnonzero(np.diff(ends, prepend=0)):
        lo, hi = (ends[b - 1] if b else 0), ends[b]
        yield int(b), [a[lo:hi] for a in sorted_arrays]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def grouped(df: DataFrame, by: str, fn: Callable[[pa.Table], Iterable[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``fn`` on each group's table; it yields rows of ``schema``."""

    def call(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([rows_of(list(fn(table)), schema)], schema=schema)

    return df.groupBy(by).applyInArrow(call, ddl)


def doc_chunks(
    batches: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int = 1 << 14
) -> Iterator[tuple[int, list[pa.Array], list[bytes]]]:
    """(chunk number, its other columns, its texts) of batches whose last column is the text.

    A chunk has bounded rows and bytes (or one longer text), and only its texts are held.
    """
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for batch in batches:
        text = batch.column(batch.num_columns - 1).cast(pa.binary())
        upto = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(text):
            done = upto[first - 1] if first else 0
            last = int(np.searchsorted(upto, done + most_bytes, "right"))
            last = min(max(last, first + 1), first + most_rows, len(text))
            part = [t or b"" for t in text.slice(first, last - first).to_pylist()]
            yield number, [c.slice(first, last - first) for c in batch.columns[:-1]], part
            number += 1
            first = last


# ---- words and their hashes --------------------------------------------------------------

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_MIX = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
for _c in range(65, 91):
    _MIX[_c] = _MIX[_c + 32]  # A-Z like a-z
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed in one pass.
PASS_BYTES = 1 << 19
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _R), ("down", _R_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_pass(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words of ``data``, which starts and ends with a space."""
    up, down = _powers(len(data) + 1)
    gap = SPACES[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIX[data] * up[: len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mix(value ^ (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, number of words of each text).

    Words are runs of bytes other than space and 9 to 13; A-Z hash like a-z.
    """
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < PASS_BYTES):
            size += len(texts[last]) + 1
            last += 1
        if last == first + 1 and len(texts[first]) > PASS_BYTES:
            for part in _parts(texts[first]):
                h, _ = _hash_pass(np.frombuffer(b" " + part + b" ", np.uint8))
                hashes.append(h)
                sizes[first] += len(h)
        else:
            h, at = _hash_pass(np.frombuffer(b" " + b" ".join(texts[first:last]) + b" ", np.uint8))
            begins = np.cumsum([1] + [len(t) + 1 for t in texts[first:last]])
            sizes[first:last] = np.diff(np.searchsorted(at, begins))
            hashes.append(h)
        first = last
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), sizes


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text cut at spaces into parts of about ``PASS_BYTES``."""
    at = 0
    while at < len(text):
        end = at + PASS_BYTES
        while end < len(text) and not SPACES[text[end]]:
            end += 1
        yield text[at:end]
        at = end

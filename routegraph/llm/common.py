"""Helpers shared by the corpus operators: text columns, written tables, packed exchanges."""

from __future__ import annotations

import threading
import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegraph.operators.lineage import remove
from routegraph.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Java patterns of the two word definitions the queries use.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the faster way where every character is ASCII."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(lowered: Column) -> Column:
    """The words of a lower-cased text: runs of digits, a-z and non-ASCII characters."""
    return F.array_remove(F.split(lowered, ALNUM_BREAK), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: lambdas would compute it for every element."""
    return F.transform(F.array(value), body)[0]


def table_path(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint directory (storage all executors share)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Owner of the tables written inside a ``with`` block.

    If the block fails, they are deleted. If it ends, those that ``only`` did not name are
    deleted, if it was called; the others belong to the block around it, or go when the
    application ends.
    """

    _open = threading.local()

    def __init__(self) -> None:
        self.tables: dict[str, SparkSession] = {}
        self.named: set[str] | None = None

    @classmethod
    def stack(cls) -> list["Scratch"]:
        if not hasattr(cls._open, "stack"):
            cls._open.stack = []
        return cls._open.stack

    def __enter__(self) -> "Scratch":
        self.stack().append(self)
        return self

    def only(self, *tables: DataFrame) -> None:
        """Nothing but these tables is read after the block."""
        self.named = {t.scratch_path for t in tables}

    def __exit__(self, kind, *_) -> None:
        self.stack().pop()
        around = self.stack()[-1] if self.stack() else None
        for path, spark in self.tables.items():
            if kind is not None or self.named is not None and path not in self.named:
                remove(spark, path)
            elif around is not None:
                around.tables[path] = spark
            else:
                remove(spark, path, at_exit=True)


def owner(operator):
    """The operator as a ``Scratch`` block of its own."""

    @wraps(operator)
    def run(*args, **kwargs):
        with Scratch():
            return operator(*args, **kwargs)

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = table_path(spark, name)
    stack = Scratch.stack()
    if stack:
        stack[-1].tables[path] = spark
    else:
        remove(spark, path, at_exit=True)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)
        for scope in Scratch.stack():
            scope.tables.pop(t.scratch_path, None)


def crc32_sql(text: str, entries: str = "entries") -> str:
    """DuckDB text: the unsigned CRC-32 of the UTF-8 bytes of ``text``, which must not be empty;
    ``entries`` names a column with ``CRC32_ENTRIES``."""
    pairs = f"string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')"
    code = f"list_transform(list_filter({pairs}, lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT)"
    ones = "4294967295::BIGINT"
    return f"xor(list_reduce({code}, lambda c, b: xor(c >> 8, {entries}[(xor(c, b) & 255) + 1]), {ones}), {ones})"


def _crc32_entries() -> str:
    """The table of the check sum, from its polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return "[" + ",".join(map(str, out)) + "]::BIGINT[]"


CRC32_ENTRIES = _crc32_entries()


def bits_for(rows: int, per_cell: int, least: int) -> int:
    """Bits of a hash prefix that cuts ``rows`` rows into cells of about ``per_cell`` rows."""
    return max(least, (max(rows, 1) // per_cell).bit_length())

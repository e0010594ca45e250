"""Tables that the rounds of a graph operator join without shuffling them.

``BucketedTable`` is a table under the checkpoint dir, bucketed by its keys and appended to.
``SaltedEdges`` is an edge table bucketed by one endpoint, whose hubs (vertices with more than
``hub_edges`` edges at that end) are dealt to several buckets: a round shuffles only what
meets the edges, with the rows of hubs repeated for each of their buckets.

``spread`` and ``looked_up`` join and group tables of counted rows in as many tasks as the rows
need, where the session's shuffle partitions are too few for them; ``real_pairs`` are the joined
pairs of a graph, made that way.

Bucketed tables need a catalog entry: external tables in the session's current database, or
in the one ``database`` names, dropped when the run ends. A driver that dies leaves the
entries behind.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from routegraph.operators.graph import Graph
from routegraph.operators.lineage import RoundTables, row_count
from routegraph.sources.spread import session_partitions, spread

#: Approximate in-memory bytes of one narrow row, used against the session's broadcast budget.
NARROW_ROW_BYTES = 48
#: Target rows per bucket (~16 bytes each: a few tens of MB per bucket).
ROWS_PER_BUCKET = 2_000_000
#: Edges at one vertex from which on they are spread over several buckets.
HUB_EDGES = 1_000_000


def broadcast_budget_bytes(spark) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    raw = str(raw).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for suffix in sorted(units, key=len, reverse=True):
        if raw.endswith(suffix):
            return int(float(raw[: -len(suffix)]) * units[suffix])
    return int(raw)


def fits(spark, rows: int, row_bytes: int = NARROW_ROW_BYTES) -> bool:
    """Do counted rows fit the session's broadcast budget?"""
    budget = broadcast_budget_bytes(spark)
    return 0 <= budget and rows * row_bytes <= budget


class BucketedTable:
    """A table under the checkpoint dir, bucketed by ``keys`` and appended to.

    Spark assigns buckets with the hash of a shuffle, so a join on the keys shuffles only
    its other side, provided the table has no fewer buckets than the session has shuffle
    partitions. It is an external table: dropping it keeps the files.
    """

    def __init__(
        self, t: RoundTables, name: str, keys: list[str], max_rows: int, database: str | None, rows_per_bucket: int
    ) -> None:
        self.t, self.spark, self.keys, self.rel, self.database = t, t.spark, keys, name, database
        self.path = t.path(name)
        self.name = f"{database + '.' if database else ''}routegraph_{name}_{uuid.uuid4().hex}"
        self.buckets = max(1, session_partitions(self.spark), math.ceil(max_rows / rows_per_bucket))
        #: Appends since the table was last written as a whole, and the files of the last one.
        self.appends, self.newest = 0, None
        self._files: set[str] = set()

    def append(self, df: DataFrame, arranged: bool = False) -> int:
        """Append rows, ``arranged`` if they are already partitioned like the buckets."""
        obs = Observation()
        if not arranged:
            df = df.repartition(self.buckets, *self.keys)  # one file per bucket
        (
            df.observe(obs, F.count(F.lit(1)).alias("n"))
            .write.mode("append")
            .bucketBy(self.buckets, *self.keys)
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        files = self.t.files(self.rel)
        self.newest = None if files is None else sorted(set(files) - self._files)
        self._files = set(files or ())
        self.appends += 1
        return obs.get["n"]

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def appended(self, schema: str) -> DataFrame | None:
        """The rows of the last append alone, where its files are known."""
        return self.spark.read.schema(schema).parquet(*self.newest) if self.newest else None

    def compacted(self) -> "BucketedTable":
        """The same rows in one file per bucket; this table and its files go."""
        base, _, n = self.rel.partition("_compact_")
        new = BucketedTable(self.t, f"{base}_compact_{int(n or 0) + 1}", self.keys, 1, self.database, 1)
        new.buckets = self.buckets
        new.append(self.table())
        new.appends = 0
        self.drop()
        self.t.delete(self.rel)
        return new

    def files(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class SaltedEdges:
    """``edges`` (a written table of ``rows`` rows) bucketed by ``key``, hubs in several buckets."""

    def __init__(
        self, t: RoundTables, edges: DataFrame, rows: int, key: str, name: str = "ways", database: str | None = None,
        rows_per_bucket: int = ROWS_PER_BUCKET, hub_edges: int = HUB_EDGES,
    ) -> None:
        self.t, self.key, self.hub_rel = t, key, f"{name}-hubs"
        counts = edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub_edges)
        self.hubs, m = t.write(
            counts.select(key, F.ceil(F.col("n") / hub_edges).cast("int").alias("salts")), self.hub_rel, row_count()
        )
        self.n_hubs, keys = m["n"], [key]
        if self.n_hubs:
            keys = [key, "salt"]
            other = [c for c in edges.columns if c != key]
            salt = F.pmod(F.xxhash64(*other), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
            edges = self._told(edges).select(*edges.columns, salt)
        self.table = BucketedTable(t, name, keys, rows, database, rows_per_bucket)
        self.table.append(edges)

    def _told(self, df: DataFrame) -> DataFrame:
        """``df`` with the number of salts of its key where that is a hub."""
        hubs = F.broadcast(self.hubs) if fits(self.t.spark, self.n_hubs) else self.hubs
        return df.join(hubs, self.key, "left")

    def met(self, front: DataFrame, front_rows: int | None = None) -> DataFrame:
        """The edges joined with ``front`` on the key; only ``front`` is shuffled, or broadcast
        if its counted rows fit the budget."""
        if self.n_hubs:
            salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
            front = self._told(front).select(*front.columns, F.explode(salts).alias("salt"))
        elif front_rows is not None and fits(self.t.spark, front_rows):
            front = F.broadcast(front)
        return self.table.table().join(front, self.table.keys)

    def drop(self) -> None:
        self.table.drop()
        self.t.delete(self.table.rel)
        self.t.delete(self.hub_rel)


def symmetric(edges: DataFrame, *more: Column | str) -> DataFrame:
    """Every edge in both directions."""
    return edges.select("src", "dst", *more).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more)
    )


def looked_up(edges: DataFrame, rows: int, values: DataFrame, n_values: int, end: str, name: str) -> DataFrame:
    """``edges`` (of at most ``rows`` rows) whose ``end`` is an id of ``values`` (``n_values`` rows
    of unique id, value), with the value as ``name``."""
    values = values.select(F.col("id").alias(end), F.col("value").alias(name))
    if fits(edges.sparkSession, n_values):
        return edges.join(F.broadcast(values), end)
    return spread(edges, rows, end).join(values.hint("merge"), end)


def real_pairs(g: Graph, t: RoundTables, undirected: bool = False) -> tuple[DataFrame, int]:
    """(src, dst, n): the real edges of ``g`` counted per pair of vertices, and the number of
    edges. ``undirected``: per joined pair, src < dst, without self-loops.

    The edges are written and counted first, so that all that follows runs in tasks of bounded
    rows; parallel edges go before the ends are looked up, so a hub has no more rows there than
    the graph has vertices. The result is lazy and reads tables of ``t``.
    """
    ends = g.edges.select("src", "dst")
    if undirected:
        ends = ends.filter("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    ends, m = t.write(ends, "ends", row_count())
    # an id that comes twice among the vertices doubles its edges, as a join with them does
    ids, v = t.write(g.vertex_ids().groupBy("id").agg(F.count(F.lit(1)).alias("value")), "ids", row_count())
    pairs = spread(ends, m["n"], "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    for end in ("dst", "src"):
        pairs = looked_up(pairs, m["n"], ids, v["n"], end, f"{end}_times")
    n = F.col("n") * F.col("src_times") * F.col("dst_times")
    return pairs.select("src", "dst", n.alias("n")), m["n"]

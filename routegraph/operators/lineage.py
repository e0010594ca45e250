"""Round tables: how iterative operators cut lineage and learn their loop condition.

Each round of an iterative operator (hops, components) is written as a Parquet table
under the session's checkpoint directory (``spark.checkpoint.dir``: shared storage on a
cluster) and read back for the next round. One job per round does three things:

* computes the round and writes it: the lineage is cut at every round, so a lost
  executor costs at most the current round and the plan never grows with the round count;
* reports the loop condition through an ``Observation`` attached to that same write
  (row count, or a count + hash-sum fingerprint): one small row reaches the driver, no
  extra counting job, no cached blocks that an executor loss could take away;
* leaves columnar files whose sizes the planner sees, so the next round's joins are
  planned from real statistics (e.g. a small frontier is broadcast by Spark's own
  size check).

Ownership: tables that no later round reads are deleted at once, also when a round fails.
The last table is what the operator returns; its folder goes when the application ends, or
earlier by ``RoundTables.drop`` of the caller that no longer reads the result.
"""

from __future__ import annotations

import logging
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from routegraph.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)


def row_count() -> list[Column]:
    return [F.count(F.lit(1)).alias("n")]


def fingerprint(*cols: str) -> list[Column]:
    """Row count and a hash sum over ``cols``: equal fingerprints mean an unchanged set."""
    h = F.xxhash64(*[F.col(c) for c in cols]) % (1 << 40)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("h")]


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Delete a folder now, or when the application ends; on any file system Spark writes to."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:  # a remote session has no JVM here: its folders are left behind
        log.warning("%s stays: no access to its file system", path)
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if at_exit:
            fs.deleteOnExit(p)
        else:
            fs.delete(p, True)
    except Py4JError as e:  # cleanup must not fail the operator, but must not be silent
        log.warning("%s could not be removed: %s", path, e)


class RoundTables:
    """Parquet tables for the rounds of one iterative run, under the checkpoint dir."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        base = ensure_checkpoint_dir(spark).rstrip("/")
        self.root = f"{base}/routegraph-{name}-{uuid.uuid4().hex}"

    def path(self, rel: str) -> str:
        return f"{self.root}/{rel}"

    def write(self, df: DataFrame, rel: str, metrics: list[Column]) -> tuple[DataFrame, dict]:
        """Compute ``df`` into table ``rel`` in one job; return it re-read and the metrics."""
        obs = Observation()
        df.observe(obs, *metrics).write.mode("errorifexists").parquet(self.path(rel))
        return self.read(rel, df.schema), obs.get

    def read(self, rel: str, schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(rel))

    def files(self, rel: str) -> list[str] | None:
        """Data files of a table, or None where the session gives no access to its files."""
        jvm = getattr(self.spark, "_jvm", None)
        if jvm is None:
            return None
        p = jvm.org.apache.hadoop.fs.Path(self.path(rel))
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = (f.getPath() for f in fs.listStatus(p))
        return [x.toString() for x in paths if not x.getName().startswith(("_", "."))]

    def delete(self, rel: str) -> None:
        """Remove a table that no DataFrame reads any more."""
        remove(self.spark, self.path(rel))

    def drop(self) -> None:
        """Remove everything of this run."""
        remove(self.spark, self.root)

    def drop_at_exit(self) -> None:
        """Remove what is left of this run when the application ends."""
        remove(self.spark, self.root, at_exit=True)

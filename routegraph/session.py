"""Session helpers: a local session for tests/bench, and checkpoint-dir resolution.

Library operators never change session configuration. The only thing they need from
the session is a *reliable* checkpoint directory for the iterative operators
(hops, components). On a cluster that directory is named by ``spark.checkpoint.dir``
and must live on shared storage; we read it from the session and only create a
private one when it is unset *and* the master is local (tests, bench, smoke runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, app: str = "routegraph") -> SparkSession:
    """A ``local[cores]`` session configured the way tests and bench.py run."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.default.parallelism", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # keep the driver's status store small over long local runs (bench, test suites)
        .config("spark.sql.ui.retainedExecutions", "50")
        .config("spark.ui.retainedJobs", "200")
        .config("spark.ui.retainedStages", "200")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint directory, creating one only in local mode.

    Order: the SparkContext's current dir, then ``spark.checkpoint.dir`` from the
    configuration, then (local master only) a fresh private temp dir.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError(
                "spark.checkpoint.dir is not set: iterative graph operators need a directory on "
                "storage shared by all executors (e.g. HDFS/S3)."
            ) from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative graph operators need a checkpoint "
            "directory on storage shared by all executors (e.g. HDFS/S3)."
        )
    path = tempfile.mkdtemp(prefix="routegraph-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path

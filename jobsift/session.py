"""Session construction and cluster-level settings shared by tests and bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "jobsift") -> SparkSession:
    """Local session for tests and the bench.  On a cluster the caller's
    session is used as is; this is only a convenience for local runs."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("JOBSIFT_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode
    session (tests, bench) may fall back to a fresh scratch folder; on a
    cluster a machine-local folder would not survive executor loss, so an
    unset setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative operators need a "
                "shared checkpoint folder on a cluster")
        configured = tempfile.mkdtemp(prefix="jobsift-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df):
    """Write a reused intermediate once to the shared checkpoint folder and
    read it back as a plain scan.  Cuts the lineage (recovery after executor
    loss restarts from the files, not from the sources) and keeps plans that
    reuse the intermediate in several branches small."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

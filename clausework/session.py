"""Session helpers: a tuned local/cluster session and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, cpus: int | None = None,
                  app_name: str = "clausework") -> SparkSession:
    """Session with AQE on and the UI off.

    On a cluster ``master`` is left to spark-submit; locally ``local[cpus]``.
    Shuffle partitions are set for a local master only (2x its cores); on a
    cluster spark-submit's setting holds.  AQE coalesces small partitions and
    splits skewed ones at runtime.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and cpus is not None:
        master = f"local[{cpus}]"
    if master is not None:
        builder = builder.master(master)
    if master is not None and master.startswith("local"):
        builder = builder.config("spark.sql.shuffle.partitions", str(max(8, 2 * (cpus or os.cpu_count() or 8))))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Arrow batches to Python (mapInPandas, pandas UDFs) are cut by bytes
        # as well as rows: 10,000 whole contract texts could be gigabytes
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.driver.memory", os.environ.get("CLAUSEWORK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, taken from ``spark.checkpoint.dir``.

    The cluster names this folder.  A local session without one gets a
    folder under the system's temp folder; elsewhere a missing setting is an
    error, since each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
    one_machine = sc.master == "local" or sc.master.startswith("local[")
    if not path and not one_machine:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="clausework-ckpt-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one job's written tables."""
    return f"{shared_dir(spark)}/clausework/{name}-{uuid.uuid4().hex[:12]}"

"""Session helpers: a local session for tests and benches, and the shared folder.

Library operators never create a session; they use ``df.sparkSession``.
Anything that must survive the loss of an executor (stream checkpoints,
round-trip tables) goes below the folder the cluster names in
``spark.checkpoint.dir``. Only a local session without that setting gets a
private temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "runlens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench)."""
    master = master or os.environ.get("RUNLENS_MASTER", "local[8]")
    cores = _local_cores(master)
    parts = shuffle_partitions or max(8, cores)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RUNLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def _local_cores(master: str) -> int:
    if master.startswith("local[") and master.endswith("]"):
        inner = master[6:-1]
        return os.cpu_count() or 8 if inner == "*" else int(inner.split(",")[0])
    return 8


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide checkpoint folder, read from the session.

    Falls back to a fresh temporary folder only for a local master; on a
    cluster a missing setting is an error, because a machine-local folder
    would not survive the loss of an executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:   # remote session: only the conf is visible
        sc = None
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if path:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) "
                           "before running runlens jobs on a cluster")
    path = tempfile.mkdtemp(prefix="runlens-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new, unique folder below the shared folder (never reused)."""
    return f"{shared_dir(spark)}/runlens/{kind}/{uuid.uuid4().hex}"

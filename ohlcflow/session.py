"""Session helpers.

Nothing here hard-codes a cluster: on a cluster the caller's session already
carries ``spark.checkpoint.dir`` (a shared folder) and we only read it.  A
private folder is created only when the setting is absent and the master is
local (tests, the local benchmark); a cluster session without it is an error.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the snapshot plan relies on the window-group-limit rule for top-k per symbol
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # small local inputs: let AQE keep one reducer per core for the CPU-heavy
    # window stages instead of merging them down to 1 MB partitions
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
}


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "ohlcflow", extra: dict | None = None) -> SparkSession:
    """A local session with ``LOCAL_CONF`` (tests, benchmark, oracle tool).

    If a session is already active (a cluster job) it is returned unchanged,
    apart from reading or, when unset, creating the checkpoint folder: the
    local settings must not override a cluster's shuffle partitions."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(LOCAL_CONF)
    default_parts = int(cpus) if str(cpus).isdigit() else 8
    conf["spark.sql.shuffle.partitions"] = str(partitions or default_parts)
    conf["spark.driver.memory"] = os.environ.get("OHLCFLOW_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            # a driver-local folder is invisible to executors on other machines
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="ohlcflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, among what ``drop_scratch_tables`` deletes."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ohlcflow-tables/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back.

    Used for small derived tables (per-symbol chunk statistics, per-symbol
    maxima).  It cuts lineage, survives executor loss, and gives the planner
    the real file size, so the broadcast decision for the following join is
    made on a measured size (``spark.sql.autoBroadcastJoinThreshold``) and a
    shuffle join is used beyond it.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` for operators that read their input twice: itself if it is a scan with filters and
    projections, else (its plan exchanges data) written once with ``scratch_table``.

    The plan is looked at through its explanation, the only public way to it."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return scratch_table(df, name) if "Exchange" in out.getvalue() else df


def drop_scratch_tables(spark: SparkSession) -> bool:
    """Delete every table and folder written as scratch under this session's checkpoint folder.

    DataFrames built on them read those files lazily, so call this only after
    the job's last action.  Returns whether the folder existed."""
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        return False
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/ohlcflow-tables")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))

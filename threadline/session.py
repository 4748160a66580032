"""SparkSession construction and the shared scratch location.

All intermediate tables that must cut lineage or be read back go under the
directory the cluster names in ``spark.checkpoint.dir``.  Only when that is
unset (local runs, tests) do we pick one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


SCAN_PARTITIONS = "spark.threadline.scanPartitions"


def build_session(master: str | None = None, app: str = "threadline",
                  shuffle_partitions: int | None = None) -> SparkSession:
    master = master or os.environ.get("THREADLINE_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("THREADLINE_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("THREADLINE_DRIVER_MEMORY", "16g"))
    )
    if os.environ.get("THREADLINE_SCAN_PARTITIONS"):
        builder = builder.config(SCAN_PARTITIONS, os.environ["THREADLINE_SCAN_PARTITIONS"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or an already set
    checkpoint directory).  Where none is configured a local master gets a
    temporary one; on a cluster executors would not share it, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="threadline-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df):
    """Deal CPU-heavy rows anew where the session asks for it.

    A table in one unsplittable file (the small test tables) is one task.  The
    session setting ``spark.threadline.scanPartitions`` names a number of
    partitions; it is unset by default, and then nothing is shuffled."""
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def materialize(df, name: str):
    """Cut lineage with a written table in the shared checkpoint folder
    (survives executor loss, unlike a local checkpoint), then read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

"""Session helpers for tests, the bench and local runs.

Library functions never create sessions; they take the caller's, and its shared folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cluster_settings(executors: int = 1000, cores_per_executor: int = 8) -> dict[str, str]:
    """Settings for a large cluster (apply with ``SparkSession.builder.config(map=...)``).

    Shuffles start at ~3 partitions per core and let AQE coalesce small ones and split skewed
    ones; scan splits and advisory shuffle partitions are sized so a task's data fits in executor
    memory with room for sort and window buffers.  ``spark.checkpoint.dir`` must name a shared
    folder; it is the cluster's, so it is not set here."""
    cores = executors * cores_per_executor
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.shuffle.partitions": str(3 * cores),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, scratch: str | None = None,
                  app: str = "tallyforge") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if scratch:
        builder = builder.config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        builder = builder.config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.  Driver and executors of a local
    master are one process, so there an unset folder is a temporary one of this application; on a
    cluster an unset folder is an error, whatever the size of the data."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back: it is computed once, survives
    lost executors (unlike a local checkpoint), and later reads get column pruning and filter pushdown."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

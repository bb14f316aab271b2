"""Spark session helpers: one builder for tests/bench, checkpoint-dir handling."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Session for local runs.  On a cluster, pass the cluster's own session instead."""
    builder = (
        SparkSession.builder.master(master or "local[*]")
        .appName("docaudit")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DOCAUDIT_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, is a private
    folder made when the setting is unset; on a cluster that is an error, since
    executors would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="docaudit-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder; read it back.

    The written table survives executor loss (it lives in the cluster's shared
    folder, not on an executor), computes the input exactly once (an RDD
    checkpoint would compute it twice unless cached), and later readers get
    column pruning and filter pushdown.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that ``cut_lineage`` wrote in this session; results that still read them must be done."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


#: Bytes of an Arrow batch, so that a Python task's memory does not follow the length of its rows.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def find_package(spark: SparkSession) -> None:
    """Make a session ready for Python tasks.

    Workers on this host find the package where the driver did (a cluster gets
    it by --py-files), and batches are bounded in bytes unless the session's own
    configuration says how.
    """
    for key, value in BATCH.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cluster_conf(input_bytes: int, executor_cores: int = 4, executors: int = 1000) -> dict[str, str]:
    """Settings for a large cluster, sized from the input volume (e.g. 100 TB).

    * shuffle partitions: one per ~256 MB of input and at least twice the total
      cores; AQE then coalesces small partitions toward the advisory size, and
      splits skewed join partitions (a document or key holding a large share
      of the rows);
    * file splits of 256 MB keep scan tasks large enough to amortise scheduling;
    * broadcast stays AQE's runtime decision (measured sizes, 64 MB ceiling).
    """
    cores = executor_cores * executors
    partitions = max(2 * cores, input_bytes // (256 << 20))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.parquet.filterPushdown": "true",
    }

"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster session should carry. Co-partitioned joins on a subset of
# the join keys let packing run with one wide shuffle (see operators/packing.py).
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "loomwork", cores: str | int = "*", **extra: str) -> SparkSession:
    """A local session with the recommended settings, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **RECOMMENDED,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is absent and the
    session itself is local (tests, bench); a cluster without the setting is
    an error rather than a silent write to one machine's disk.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="loomwork-"))
    return context.getCheckpointDir()


# Scratch paths handed out and not yet released.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder, kept until ``release``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all scratch of this process.

    Results are read lazily from it, so the caller releases after writing them.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder; survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, label: str = "stage"):
    """Write to the shared folder as Parquet and read back.

    For intermediate tables used more than once: readers prune columns, and the
    files' size lets Catalyst choose a broadcast only below its own threshold.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def default_blocks(spark: SparkSession) -> int:
    """Number of value ranges for distributed running totals.

    Follows the shuffle width, which is set in proportion to the data, without a cap.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(8, 4 * width)


def spread(df, key: str):
    """Repartition by ``key`` only where the scan has fewer tasks than the cluster has slots.

    A large table is already split and is left alone, so its rows never move.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(key)

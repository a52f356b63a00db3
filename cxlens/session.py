"""Session helpers: recommended configuration and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. Timestamps in the data carry no zone, so
# the session zone is pinned; AQE re-plans joins and shuffle sizes at runtime
# (broadcast only after the measured size is under the threshold, skew splits).
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "cxlens", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (cluster jobs bring their own)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set, to a folder that all executors share; without
    it this raises. Only a session whose executors are threads of this machine
    (``local[...]``, as in tests) gets a private scratch folder instead.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cxlens-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back: its lineage ends there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/cxlens-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_cluster_conf(spark: SparkSession, input_bytes: int, cores: int | None = None) -> dict[str, str]:
    """Size a running session for the bytes its jobs read; returns the settings."""
    conf = cluster_conf(input_bytes, cores or spark.sparkContext.defaultParallelism)
    conf = {k: v for k, v in conf.items() if k.startswith("spark.sql.") and spark.conf.isModifiable(k)}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf


def cluster_conf(input_bytes: int, executor_cores_total: int,
                 target_partition_bytes: int = 256 << 20, shuffle_fraction: float = 0.25) -> dict[str, str]:
    """Settings for a large cluster run, sized from the bytes the jobs read.

    The largest shuffle is the order-level join, which carries the pruned
    columns only (``shuffle_fraction`` of the input). Shuffle partitions
    start at that volume / 256 MB (at least 2x the cores), and AQE coalesces
    them at runtime to the advisory size, so no partition outgrows executor
    memory.
    Skewed partitions above 5x the median and 512 MB are split by AQE.
    Auto-broadcast stays size-checked (64 MB, measured at runtime by AQE);
    nothing that grows with the data is force-broadcast.
    """
    shuffle_bytes = int(input_bytes * shuffle_fraction)
    partitions = max(2 * executor_cores_total, -(-shuffle_bytes // target_partition_bytes))
    return {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    }

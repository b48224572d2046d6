"""Session defaults, the shared work folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stream state lives on disk, not in the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Source files reach 2 MiB each, so Python batches are kept short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    master: str | None = None, app: str = "vulnspark", conf: dict | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder the cluster names.

    A temporary folder is set only where the session names none and runs in one process
    (tests): the executors of a cluster do not see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="vulnspark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/vulnspark-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut lineage by writing a Parquet table to the shared folder and reading it back.

    Unlike a cached plan it survives executor loss, and unlike a checkpointed RDD
    it carries size statistics, so later joins are planned from real sizes.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_alone(df: DataFrame, folder: str, name: str) -> DataFrame:
    """`materialize`; the shuffle files of the step go when its table is complete."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        return materialize(df, folder, name)
    finally:
        if before is None:
            conf.unset(FREE_SHUFFLES)
        else:
            conf.set(FREE_SHUFFLES, before)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer partitions than the cluster has cores.

    Only for plain scans feeding per-row work heavier than a round-robin shuffle;
    a table laid out in enough files or row groups is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

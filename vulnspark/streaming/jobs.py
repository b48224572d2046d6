"""Incremental forms of the scan, its deduplication and its counters.

Each job drains what has arrived (`availableNow`) and stops. Its checkpoint lives beside
its output in a shared folder, so a lost executor or a restart repeats no work. A source that
never had a file gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vulnspark.operators.dashboard import FINDING_LOCATION
from vulnspark.session import DEFAULTS
from vulnspark.streaming.log import BatchLog
from vulnspark.streaming.seen import FirstOfScan
from vulnspark.taxonomy import severity_rank

#: A scan's locations are dealt to so many states, so that a scan of most rows is not one task.
SLOTS = 64


def _drain(writer: DataStreamWriter, folder: str, name: str) -> None:
    query = writer.option("checkpointLocation", f"{folder}/{name}-progress").trigger(
        availableNow=True
    )
    query.start().awaitTermination()


@contextmanager
def _lists_in_state(spark: SparkSession) -> Iterator[None]:
    """Names the state store that keeps lists and timers, for queries started inside. Spark's default
    store refuses them, and a session may come without this library's settings."""
    key = "spark.sql.streaming.stateStore.providerClass"
    named = spark.conf.get(key)
    spark.conf.set(key, DEFAULTS[key])
    try:
        yield
    finally:
        spark.conf.set(key, named)


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Parquet files as they arrive; each is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _written(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at `path`; empty while no batch has written there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def stream_scan(
    files: DataFrame, scan: Callable[[DataFrame], DataFrame], folder: str
) -> DataFrame:
    """Run a batch scan over each batch of new files; returns the findings so far.

    A batch writes to a folder of its own number, so a batch repeated after a failure
    replaces its own rows instead of adding them twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{folder}/findings/batch={number}")

    _drain(files.writeStream.foreachBatch(write), folder, "scan")
    spark = files.sparkSession
    return _written(spark, f"{folder}/findings", scan(spark.createDataFrame([], files.schema)).schema)


def stream_dedup(findings: DataFrame, folder: str, within: str | None = None) -> DataFrame:
    """First arrival of each finding location.

    With `within`, state older than that span of `created_at` is dropped, which bounds it;
    without, one key per location is kept for good.
    """
    keys = list(FINDING_LOCATION)
    if within:
        unique = findings.withWatermark("created_at", within).dropDuplicatesWithinWatermark(keys)
    else:
        unique = findings.dropDuplicates(keys)
    writer = unique.writeStream.format("parquet").outputMode("append")
    _drain(writer.option("path", f"{folder}/unique"), folder, "unique")
    return _written(findings.sparkSession, f"{folder}/unique", unique.schema)


def stream_first_of_scan(findings: DataFrame, folder: str, idle: str, slots: int = SLOTS) -> DataFrame:
    """First arrival of each finding location, with state that goes when its scan is over.

    The state of a scan is a map of the locations it has seen. A timer, moved on by every new
    location, clears the map once the watermark of `created_at` is `idle` behind the scan's last
    one. Rows later than the watermark are dropped, so a cleared scan cannot report a location
    twice. A scan's locations are dealt to `slots` states by file and line.
    """
    keys = list(FINDING_LOCATION)
    slot = F.pmod(F.xxhash64(*keys[1:]), F.lit(slots)).alias("slot")
    at = F.coalesce(F.unix_millis(F.col("created_at").cast("timestamp")), F.lit(0)).alias("at")
    rows = findings.select(*keys, "created_at", at, slot).withWatermark("created_at", idle)
    unique = rows.groupBy("scan_id", "slot").transformWithStateInPandas(
        FirstOfScan(idle, keys),
        outputStructType=findings.select(*keys, "created_at").schema,
        outputMode="append",
        timeMode="eventTime",
    )
    writer = unique.writeStream.format("parquet").outputMode("append")
    with _lists_in_state(findings.sparkSession):
        _drain(writer.option("path", f"{folder}/first"), folder, "first")
    return _written(findings.sparkSession, f"{folder}/first", unique.schema)


def stream_summary(findings: DataFrame, folder: str, fold: int = 50) -> DataFrame:
    """Running finding counts by scan and severity.

    The stream appends changed counts to a log; the latest entry of each key is current. Every
    `fold` batches the log is folded into one table, so a read never takes in more.
    """
    counts = (
        findings.filter(~F.col("dismissed"))
        .groupBy("scan_id", "severity")
        .agg(F.count("*").alias("count"))
    )
    log = BatchLog(findings.sparkSession, f"{folder}/counts", counts.schema, latest_counts, fold)
    _drain(counts.writeStream.outputMode("update").foreachBatch(log.append), folder, "counts")
    return log.current().withColumn("rank", severity_rank(F.col("severity")))


def latest_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("scan_id", "severity").agg(F.max_by("count", "batch").alias("count"))

"""Findings and their dismissals in equal buckets, so that both meet without a shuffle.

Both tables are stored with the same number of buckets by finding id. Joining them, and taking the
latest dismissal of each finding, then happens inside a bucket: `dashboard.apply_dismissals` on the
stored tables plans no exchange, however large either is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING, DISMISSED = "id", "finding_id"


def store(rows: DataFrame, name: str, folder: str, key: str, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """A table of the catalog with its files in `folder`, in `buckets` sorted by `key`.

    Rows are dealt to the buckets first, so every bucket is written by one task as one file."""
    dealt = rows.repartition(buckets, key).sortWithinPartitions(key)
    writer = dealt.write.bucketBy(buckets, key).sortBy(key).option("path", folder)
    writer.mode(mode).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def store_findings(findings: DataFrame, name: str, folder: str, buckets: int) -> DataFrame:
    return store(findings, name, folder, FINDING, buckets)


def append_dismissals(dismissals: DataFrame, name: str, folder: str, buckets: int) -> DataFrame:
    """Adds to the (finding_id, reason, at, seq) log; the first call makes it."""
    return store(dismissals.select(DISMISSED, "reason", "at", "seq"), name, folder, DISMISSED, buckets, "append")


def compacted(log: DataFrame) -> DataFrame:
    """The log with the latest dismissal of each finding only; buckets stay as they are."""
    last = F.max_by(F.struct("reason", "at", "seq"), F.struct("at", "seq")).alias("last")
    return log.groupBy(DISMISSED).agg(last).select(DISMISSED, "last.*")


def compact_dismissals(log: DataFrame, name: str, folder: str, buckets: int) -> DataFrame:
    """Stores the compacted log as a table of its own, one file a bucket; readers change over to it
    when it is complete, so a job lost on the way costs nothing but its files."""
    return store(compacted(log), name, folder, DISMISSED, buckets)

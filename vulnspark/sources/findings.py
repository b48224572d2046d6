"""Findings and scans tables, report files, and the calibration lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark import schemas

ROUND_DIGITS = 4
#: Columns the stored tables are clustered by.
FINDINGS_ORDER, SCANS_ORDER = ("scan_id", "id"), ("id",)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.FINDINGS)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.SCANS)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, bounds: tuple, partitions: int
) -> DataFrame:
    """A relational table, read as `partitions` parallel ranges of `column`."""
    low, high = bounds
    return spark.read.jdbc(
        url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions
    )


def stored_form(findings: DataFrame) -> DataFrame:
    """Scores and probabilities rounded for storage."""
    lines = F.transform(
        "contributing_lines",
        lambda a: F.struct(
            a["line"].alias("line"),
            F.round(a["score"], ROUND_DIGITS).alias("score"),
            a["text"].alias("text"),
        ),
    )
    rounded = F.transform_values("probabilities", lambda _, p: F.round(p, ROUND_DIGITS))
    return findings.withColumns({"contributing_lines": lines, "probabilities": rounded})


def clustered(rows: DataFrame, files: int | None = None, order: tuple[str, ...] = FINDINGS_ORDER) -> DataFrame:
    """Rows in ranges of `order`, as the table is stored.

    Ranges split a scan that holds most rows over many tasks, and keep each file's scan range
    short, so that reading one scan skips the other row groups.
    """
    ranges = rows.repartitionByRange(*order) if files is None else rows.repartitionByRange(files, *order)
    return ranges.sortWithinPartitions(*order)


def write_findings(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet clustered by scan; `retention.delete_scans` removes scans from it."""
    clustered(stored_form(findings)).write.mode(mode).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON file for a report of few rows (build, benchmark, calibration, training)."""
    report.repartition(1).write.json(path)


def with_temperature(rows: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Fitted temperature of each row's model, or 1.0 and `calibrated = false`."""
    fitted = calibrations.select("model_version", F.col("temperature").alias("fitted"))
    joined = rows.join(fitted, "model_version", "left")
    temperature = F.coalesce("fitted", F.lit(1.0))
    return joined.withColumns(
        {"temperature": temperature, "calibrated": temperature != 1.0}
    ).drop("fitted")

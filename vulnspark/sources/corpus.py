"""Corpus records: read, write, check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark import schemas
from vulnspark.taxonomy import LABELS


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under the fixed schema; a malformed line fails the read."""
    return spark.read.schema(schemas.CORPUS).json(path, mode="FAILFAST")


def write_corpus(records: DataFrame, path: str) -> int:
    """JSON lines; returns how many were written (line breaks inside text are escaped)."""
    records.write.json(path)
    # Counted from the output: an Observation stays with the session, and tasks of later ML models
    # that take the session along can then not be serialized.
    return records.sparkSession.read.text(path).count()


def write_splits(records: DataFrame, path: str) -> None:
    """Parquet by split, so that readers of one split never open the others."""
    records.write.partitionBy("split").parquet(path)


def violation() -> Column:
    """Name of the first broken record invariant; null when the record is sound."""
    synthetic = F.col("source").isin(*schemas.SYNTHETIC_SOURCES)
    return (
        F.when(F.coalesce(F.col("repository_id"), F.lit("")) == "", "missing_repository")
        .when(~F.coalesce(F.col("source").isin(*schemas.SOURCES), F.lit(False)), "unknown_source")
        .when(~F.col("is_synthetic").eqNullSafe(synthetic), "synthetic_flag_contradicts_source")
        .when(
            ~F.coalesce(F.col("vulnerability_type").isin(*LABELS), F.lit(False)), "unknown_label"
        )
    )


def with_violation(records: DataFrame) -> DataFrame:
    return records.withColumn("violation", violation())


def valid_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """Sound records only; strict mode fails the job at the first broken one."""
    marked = with_violation(records)
    if strict:
        message = F.concat(F.lit("corpus record violates "), F.col("violation"))
        checked = F.when(F.col("violation").isNull(), F.lit(True)).otherwise(
            F.raise_error(message).cast("boolean")
        )
        return marked.filter(checked).drop("violation")
    return marked.filter(F.col("violation").isNull()).drop("violation")


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """All sources as one corpus, matched by column name."""
    first, *rest = corpora
    for other in rest:
        first = first.unionByName(other)
    return first

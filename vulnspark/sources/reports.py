"""Static-analysis and rule-scanner reports as hits, and popularity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark import schemas
from vulnspark.taxonomy import label_from_cwe, label_from_rule, label_id


def _read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    report = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    if report.isEmpty():
        # Going on would label a whole corpus SAFE without a word.
        raise ValueError(f"no report under {path}")
    return report


def read_cwe_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, cwe) rows. A list of CWE texts arrives as its JSON text, which is enough
    for picking the ids out of it."""
    results = _read_report(spark, path, schemas.CWE_REPORT).select(F.inline("results"))
    return results.select(
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("start.line", F.lit(0)).alias("line"),
        F.col("extra.metadata.cwe").alias("cwe"),
    )


def cwe_hits(report: DataFrame, keys: tuple[str, ...] = ("path", "line")) -> DataFrame:
    """One row per CWE id that maps onto the taxonomy; the others are dropped.

    `ord` is the place of the id within its finding.
    """
    ids = F.regexp_extract_all(F.col("cwe"), F.lit(r"CWE-\d+"), F.lit(0))
    return (
        report.select(*keys, F.posexplode_outer(ids).alias("ord", "cwe_id"))
        .withColumn("label", label_from_cwe(F.col("cwe_id")))
        .filter(F.col("label").isNotNull())
    )


def read_rule_report(spark: SparkSession, path: str) -> DataFrame:
    """(filename, test_id, pos) rows; `pos` is the order within the report."""
    report = _read_report(spark, path, schemas.RULE_REPORT)
    return report.select(F.posexplode("results").alias("pos", "r")).select("r.*", "pos")


def rule_predictions(records: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Class id per record: its first finding, in report order, that maps; else 0."""
    first = (
        findings.select(key, "pos", label_id(label_from_rule(F.col("test_id"))).alias("y"))
        .filter(F.col("y").isNotNull())
        .groupBy(key)
        .agg(F.min_by("y", "pos").alias("y"))
    )
    return (
        records.select(key)
        .join(first, key, "left")
        .select(key, F.coalesce("y", F.lit(0)).alias("y_pred"))
    )


def top_names(ranking: DataFrame, limit: int, order: tuple = ("pos",)) -> DataFrame:
    """First `limit` non-empty names of a popularity list, in list order (a distributed top-k)."""
    named = ranking.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    return named.orderBy(*order).limit(limit)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name) of a popularity list: {"rows": [...]} of {"project": name} or plain names."""
    raw = spark.read.schema("rows array<string>").json(path, multiLine=True, mode="FAILFAST")
    rows = raw.select(F.posexplode("rows").alias("pos", "row"))
    project = F.get_json_object("row", "$.project")
    return rows.select(
        "pos", F.when(F.col("row").startswith("{"), project).otherwise(F.col("row")).alias("name")
    )

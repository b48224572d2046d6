"""Reports over findings and scans, for all scans at once or filtered to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnspark.taxonomy import label_dim, remediation_dim, severity_of_rank, severity_rank

FINDING_LOCATION = ("scan_id", "file_path", "function_name", "start_line")


def active(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("dismissed"))


# --- summaries ---


def summary_by_severity(findings: DataFrame) -> DataFrame:
    """Active findings per scan and severity; `rank` orders the worst first."""
    return (
        active(findings)
        .groupBy("scan_id", "severity")
        .agg(F.count("*").alias("count"))
        .withColumn("rank", severity_rank(F.col("severity")))
    )


def summary_by_type(findings: DataFrame) -> DataFrame:
    return (
        active(findings).groupBy("scan_id", "vulnerability_type").agg(F.count("*").alias("count"))
    )


def summary_by_file(findings: DataFrame, top: int = 50) -> DataFrame:
    """The files of each scan with most active findings, and their worst severity.

    One aggregate; ranking then sees a row per file and keeps `top` per scan before and
    after its shuffle.
    """
    files = (
        active(findings)
        .groupBy("scan_id", "file_path")
        .agg(
            F.count("*").alias("count"),
            severity_of_rank(F.max(severity_rank(F.col("severity")))).alias("highest_severity"),
        )
    )
    rank = F.row_number().over(
        W.partitionBy("scan_id").orderBy(F.col("count").desc(), F.col("file_path"))
    )
    return files.withColumn("rank", rank).filter(F.col("rank") <= top)


def _of_every_scan(scans: DataFrame, summary: DataFrame) -> DataFrame:
    """The summary joined to all scans (`id`); a scan without rows in it keeps nulls."""
    return scans.select(F.col("id").alias("scan_id")).join(summary, "scan_id", "left")


def summary_totals(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Active findings and mean confidence of every scan; without any, 0 and a null mean."""
    totals = active(findings).groupBy("scan_id").agg(
        F.count("*").alias("total_findings"), F.avg("confidence").alias("mean_confidence")
    )
    return _of_every_scan(scans, totals).select(
        "scan_id", F.coalesce("total_findings", F.lit(0)).alias("total_findings"), "mean_confidence"
    )


def dashboard_summary(findings: DataFrame, scans: DataFrame, top: int = 50) -> DataFrame:
    """All summaries of every scan in one pass: (scan_id, section, key, count, ...).

    Scans take part as rows that count nothing, so those without findings need no second pass.
    Sections: total (of scans without findings too), severity, type, and file with the `top`
    files of most findings. The rank filter is applied before its shuffle as well.
    """
    rank = severity_rank(F.col("severity"))
    scan, severity, kind, path = map(
        F.col, ("scan_id", "severity", "vulnerability_type", "file_path")
    )
    columns = ["scan_id", "severity", "vulnerability_type", "file_path", "confidence"]
    real = active(findings).select(*columns, rank.alias("_rank"), F.lit(1).cast("bigint").alias("_real"))
    known = scans.select(F.col("id").alias("scan_id"), F.lit(0).cast("bigint").alias("_real"))
    grouped = (
        real.unionByName(known, allowMissingColumns=True)
        .groupingSets(
            [[scan], [scan, severity], [scan, kind], [scan, path]], scan, severity, kind, path
        )
        .agg(
            F.sum("_real").alias("count"),
            F.avg("confidence").alias("mean_confidence"),
            severity_of_rank(F.max("_rank")).alias("highest_severity"),
            F.grouping("severity").alias("g_severity"),
            F.grouping("vulnerability_type").alias("g_type"),
            F.grouping("file_path").alias("g_file"),
        )
    )
    section = (
        F.when(F.col("g_severity") == 0, "severity")
        .when(F.col("g_type") == 0, "type")
        .when(F.col("g_file") == 0, "file")
        .otherwise("total")
    )
    key = F.coalesce("severity", "vulnerability_type", "file_path", F.lit(""))
    columns = ["scan_id", "section", "key", "count", "mean_confidence", "highest_severity"]
    # Groups of scan rows alone say nothing but for the total.
    told = grouped.withColumns({"section": section, "key": key}).filter((F.col("count") > 0) | (F.col("section") == "total"))
    found = told.select(*columns)
    largest = W.partitionBy("scan_id", "section").orderBy(F.col("count").desc(), F.col("key"))
    # Totals, severities and types are fewer than any useful `top`.
    return found.withColumn("_place", F.row_number().over(largest)).filter(F.col("_place") <= top).drop("_place")


def scan_counters(scans: DataFrame, files: DataFrame, chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, chunks and findings of every scan. Each side is aggregated before the join."""
    n = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return (
        _of_every_scan(scans, n(files, "files_scanned"))
        .join(n(chunks, "functions_scanned"), "scan_id", "left")
        .join(n(findings, "findings_count"), "scan_id", "left")
        .select("scan_id", zero("files_scanned"), zero("functions_scanned"), zero("findings_count"))
    )


# --- lists and lookups ---


def _check_page(limit: int, most: int, offset: int) -> None:
    if not (1 <= limit <= most and offset >= 0):
        raise ValueError(f"limit must be within 1..{most} and offset not negative")


def _owned(scans: DataFrame, user_id, scan_id=None) -> DataFrame:
    """Ids of a user's scans; one scan's id when it is given (a key: one row at most)."""
    own = scans.filter(F.col("user_id") == user_id)
    if scan_id is None:
        return own.select(F.col("id").alias("scan_id"))
    one = own.filter(F.col("id") == scan_id).select(F.col("id").alias("scan_id"))
    return F.broadcast(one.limit(1))


def list_findings(
    findings: DataFrame,
    scans: DataFrame,
    user_id,
    scan_id,
    severity: str | None = None,
    vulnerability_type: str | None = None,
    file_path: str | None = None,
    include_dismissed: bool = False,
    limit: int = 200,
    offset: int = 0,
) -> DataFrame:
    """A page of one owned scan's findings, most confident first, ties by id.

    Filters reach the Parquet scan; the page is a distributed top-k.
    """
    _check_page(limit, 1000, offset)
    chosen = findings.filter(F.col("scan_id") == scan_id)
    if not include_dismissed:
        chosen = active(chosen)
    if severity:
        chosen = chosen.filter(F.col("severity") == severity.upper())
    if vulnerability_type:
        chosen = chosen.filter(F.col("vulnerability_type") == vulnerability_type.upper())
    if file_path:
        chosen = chosen.filter(F.col("file_path") == file_path)
    own = chosen.join(_owned(scans, user_id, scan_id), "scan_id", "left_semi")
    return own.orderBy(F.col("confidence").desc(), "id").offset(offset).limit(limit)


def list_scans(scans: DataFrame, user_id, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a user's scans, newest first, ties by id."""
    _check_page(limit, 200, offset)
    own = scans.filter(F.col("user_id") == user_id)
    return own.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def owned_scan(scans: DataFrame, user_id, scan_id) -> DataFrame:
    """The scan, or no row: absent and foreign look alike."""
    return scans.filter((F.col("id") == scan_id) & (F.col("user_id") == user_id))


def owned_finding(findings: DataFrame, scans: DataFrame, user_id, finding_id) -> DataFrame:
    one = findings.filter(F.col("id") == finding_id)
    return one.join(_owned(scans, user_id), "scan_id", "left_semi")


def owned_findings(findings: DataFrame, scans: DataFrame, user_id) -> DataFrame:
    return findings.join(_owned(scans, user_id), "scan_id", "left_semi")


def with_remediation(findings: DataFrame) -> DataFrame:
    """Adds `remediation`: the class's advice, null for a label without any."""
    advice = remediation_dim(findings.sparkSession).select(
        "vulnerability_type",
        F.struct("title", "explanation", "unsafe_example", "safe_example").alias("remediation"),
    )
    return findings.join(F.broadcast(advice), "vulnerability_type", "left")


def taxonomy(findings: DataFrame) -> DataFrame:
    """Every class in order, its severity, whether advice exists, and its finding count."""
    counts = findings.groupBy(F.col("vulnerability_type").alias("label")).agg(
        F.count("*").alias("n_findings")
    )
    return (
        label_dim(findings.sparkSession)
        .join(counts, "label", "left")
        .withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    )


# --- maintenance jobs ---


def latest_dismissals(dismissals: DataFrame) -> DataFrame:
    """The last dismissal of each finding in an append-only (finding_id, reason, at, seq) log."""
    last = F.max_by("reason", F.struct("at", "seq"))
    return dismissals.groupBy("finding_id").agg(last.alias("_reason"))


def apply_dismissals(findings: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Findings with `dismissed` and `dismissed_reason` brought up to date."""
    last = latest_dismissals(dismissals).withColumnRenamed("finding_id", "id")
    marked = findings.join(last.withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return marked.withColumns(
        {
            "dismissed": F.col("dismissed") | hit,
            "dismissed_reason": F.when(hit, F.col("_reason")).otherwise(F.col("dismissed_reason")),
        }
    ).drop("_hit", "_reason")


def retain(rows: DataFrame, deletions: DataFrame, key: str = "scan_id") -> DataFrame:
    """Rows of scans that were not deleted: for `scans` by id, for `findings` by scan_id."""
    gone = deletions.select(F.col("scan_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti")


def duplicate_locations(findings: DataFrame) -> DataFrame:
    """Location keys held by more than one finding."""
    return (
        findings.groupBy(*FINDING_LOCATION).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    )


def first_per_location(findings: DataFrame, order: list[Column | str]) -> DataFrame:
    """The first finding of each location, by `order`."""
    rank = F.row_number().over(W.partitionBy(*FINDING_LOCATION).orderBy(*order))
    return findings.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")

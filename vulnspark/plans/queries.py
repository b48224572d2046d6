"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.functions import paths, probability, text
from vulnspark.operators import (
    bucketed,
    calibrate,
    chunks,
    classifier,
    dashboard,
    dedup,
    evaluate,
    label_function,
    labeling,
    localize,
    pages,
    scan,
    source,
    splits,
    sweep,
)
from vulnspark.plans import inputs
from vulnspark.plans.build import build_corpus
from vulnspark.session import materialize, spread, work_folder
from vulnspark.sources import archives, corpus, findings, reports
from vulnspark.sources import retention as rewriting
from vulnspark.streaming import jobs
from vulnspark.taxonomy import severity_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Small enough for SQL to replay the whole computation.
DEDUP = {"num_perm": 16, "bands": 4, "mode": dedup.SHA1}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


# --- sources and sinks ---


@query
def corpus_roundtrip(spark, sf):
    folder = work_folder(spark)
    corpus.write_corpus(inputs.corpus(spark, sf).drop("doc_id"), f"{folder}/corpus")
    back = corpus.read_corpus(spark, f"{folder}/corpus")
    return back.select(
        "repository_id", "file_path", F.sha2("code", 256).alias("code_digest"),
        "vulnerability_type", "start_line", "end_line", "source", "is_synthetic",
        F.size("vulnerable_lines").alias("n_lines"), F.col("metadata")["lang"].alias("lang"),
    )


@query
def corpus_invariants(spark, sf):
    # Some flags are turned over and some names blanked, so that every check has work.
    bad = inputs.corpus_keys(spark, sf).withColumns(
        {
            "is_synthetic": F.when(F.col("doc_id") % 11 == 0, ~F.col("is_synthetic")).otherwise(F.col("is_synthetic")),
            "repository_id": F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("repository_id")),
            "vulnerability_type": F.when(F.col("doc_id") % 17 == 0, "RETIRED").otherwise(F.col("vulnerability_type")),
        }
    )
    return corpus.with_violation(bad).select("doc_id", "violation")


@query
def cwe_hits(spark, sf):
    hits = reports.cwe_hits(inputs.cwe_report(spark, sf), ("event_id", "path", "line"))
    return hits.select("event_id", "path", "line", "ord", "cwe_id", "label")


@query
def rule_baseline_pred(spark, sf):
    return reports.rule_predictions(
        inputs.rule_records(spark, sf), inputs.rule_findings(spark, sf), "record_id"
    )


@query
def top_sources(spark, sf):
    ranking = inputs.table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(
        F.count("*").alias("n")
    )
    return reports.top_names(ranking, 10, (F.col("n").desc(), "name"))


@query
def archive_members(spark, sf):
    members = archives.archive_members(inputs.zip_archives(spark, sf))
    return members.select("archive", "format", "member_index", "name", "kind", "size")


@query
def archive_sources(spark, sf):
    sources = archives.read_sources(inputs.zip_archives(spark, sf))
    return sources.select("archive", "file_path", F.sha2("content", 256).alias("digest"))


@query
def skipped_files(spark, sf):
    read = archives.read_members(inputs.mixed_archives(spark, sf))
    left = read.filter("reason IS NOT NULL").drop("content")
    parsed = source.parse_files(read.filter("reason IS NULL"), ["archive", "file_path"], source.FUNCTIONS)
    return left.unionByName(source.unparsable_files(parsed, ["archive", "file_path"]))


@query
def archive_verdict(spark, sf):
    return archives.archive_verdicts(inputs.archive_members(spark, sf))


@query
def source_select(spark, sf):
    return archives.select_sources(inputs.archive_members(spark, sf))


@query
def mining_select(spark, sf):
    members = archives.mining_files(inputs.archive_members(spark, sf))
    return members.select("archive", "name", "size")


@query
def findings_sink(spark, sf):
    folder = work_folder(spark)
    findings.write_findings(_scan(spark, sf), f"{folder}/findings")
    back = findings.read_findings(spark, f"{folder}/findings")
    return _plain_findings(back, 4)


@query
def report_sink(spark, sf):
    folder = work_folder(spark)
    table = evaluate.benchmark_table(inputs.labeled_pairs(spark, sf))
    findings.write_report(table, f"{folder}/benchmark")
    back = spark.read.schema(table.schema).json(f"{folder}/benchmark", mode="FAILFAST")
    return _rounded(back)


@query
def calibration_lookup(spark, sf):
    looked_up = findings.with_temperature(
        inputs.scans(spark, sf), inputs.calibrations(spark, sf)
    )
    return looked_up.select("id", "model_version", "temperature", "calibrated")


# --- scalar functions ---


@query
def fingerprint(spark, sf):
    docs = inputs.documents(spark, sf)
    return docs.select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


def _token_digest(spark, sf, tokens: Callable[[Column], Column]) -> DataFrame:
    toks = inputs.documents(spark, sf).select("doc_id", tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def tokens(spark, sf):
    return _token_digest(spark, sf, text.tokens)


@query
def tokens_ml(spark, sf):
    return _token_digest(spark, sf, text.tokens_ml)


@query
def shingles(spark, sf):
    shs = inputs.documents(spark, sf).select(
        "doc_id", text.shingles(text.tokens(F.col("text"))).alias("s")
    )
    digest = F.md5(F.array_join(F.array_sort("s"), "|"))
    return shs.select("doc_id", F.size("s").alias("n"), digest.alias("digest"))


@query
def repo_bucket(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    bucket = splits.repo_bucket(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return docs.select("doc_id", F.round(bucket, 9).alias("bucket"))


@query
def severity_map(spark, sf):
    records = inputs.corpus_keys(spark, sf)
    return records.select("doc_id", "vulnerability_type", severity_for(F.col("vulnerability_type")).alias("severity"))


@query
def char_entropy(spark, sf):
    docs = inputs.documents(spark, sf)
    return docs.select("doc_id", r6(text.char_entropy(F.col("text"))).alias("entropy"))


@query
def secret_literals(spark, sf):
    found = labeling.text_assignments(inputs.documents(spark, sf), ["doc_id"])
    return found.select(
        "doc_id", "pos", "name", "value",
        text.is_secret_literal(F.col("name"), F.col("value")).alias("is_secret"),
    )


@query
def safe_paths(spark, sf):
    return inputs.archive_members(spark, sf).select(
        "member_index", "name",
        paths.is_safe_member(F.col("name")).alias("safe"),
        paths.in_skipped_directory(F.col("name")).alias("skipped"),
        paths.is_python_file(F.col("name")).alias("python"),
    )


@query
def offset_to_line(spark, sf):
    docs = inputs.documents(spark, sf)
    offset = F.octet_length("text") * (F.col("doc_id") % 5) / 4 - F.col("doc_id") % 3
    return docs.withColumn("offset", F.floor(offset)).select(
        "doc_id", "offset",
        text.line_of_offset(F.col("text"), F.lit(10), F.col("offset")).alias("line"),
    )


@query
def snippets(spark, sf):
    docs = inputs.documents(spark, sf)
    total = F.size(text.split_lines(F.col("text")))
    first = F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2)
    cut = text.snippet(F.col("text"), F.col("first"), F.col("last"), 40)
    spans = docs.withColumns({"first": first, "last": F.greatest(total, F.lit(2))})
    return spans.select("doc_id", F.md5(cut).alias("digest"), F.size(F.split(cut, "\n")).alias("n_lines"))


@query
def argmax_pred(spark, sf):
    rows = inputs.logits(spark, sf)
    return rows.select("vec_id", probability.argmax(F.col("logits")).alias("y_pred"))


@query
def softmax_probs(spark, sf):
    probs = inputs.logits(spark, sf).select(
        "vec_id", probability.softmax(F.col("logits"), 1.5).alias("p")
    )
    return probs.select("vec_id", *[r6(F.col("p")[i]).alias(f"p{i}") for i in range(7)])


@query
def one_hot(spark, sf):
    hot = inputs.labeled_pairs(spark, sf).select("y_pred", probability.one_hot(F.col("y_pred")).alias("v"))
    totals = [F.sum(F.col("v")[i]).cast("bigint").alias(f"hot{i}") for i in range(7)]
    return hot.groupBy("y_pred").agg(*totals)


@query
def prob_map(spark, sf):
    probs = inputs.logits(spark, sf).select(
        "vec_id", probability.softmax(F.col("logits")).alias("p")
    )
    named = probs.select("vec_id", F.explode(probability.class_map(F.col("p"), 4)).alias("label", "probability"))
    return named


# --- row generators ---


def _chunk_query(scope: str):
    def run(spark, sf):
        rows = chunks.chunk_files(inputs.python_modules(spark, sf), ["scan_id", "file_path"], scope)
        return rows.select(
            "scan_id", "file_path", "name", "start_line", "end_line", "start_byte", "end_byte",
            F.sha2("code", 256).alias("code_digest"),
            F.coalesce(F.col("metadata")["scope"], F.lit("function")).alias("scope"),
        )

    return run


QUERIES["chunk_functions"] = _chunk_query(chunks.FUNCTIONS)
QUERIES["chunk_module"] = _chunk_query(chunks.MODULE)
QUERIES["chunk_all"] = _chunk_query(chunks.ALL)


@query
def chunk_udtf(spark, sf):
    chunks.register_chunk_udtf(spark)
    inputs.python_modules(spark, sf).createOrReplaceTempView("vulnspark_modules")
    return spark.sql(
        "SELECT m.scan_id, m.file_path, c.name, c.start_line, c.end_line "
        "FROM vulnspark_modules m, LATERAL chunk_source(m.content, 'all') c"
    )


@query
def line_windows(spark, sf):
    return inputs.document_chunks(spark, sf).select(
        "doc_id", "window_index", "window_count", "start_line", "end_line",
        "start_byte", "end_byte", F.sha2("code", 256).alias("code_digest"),
    )


@query
def label_files(spark, sf):
    return labeling.detect(inputs.python_modules(spark, sf), ["file_path"])


@query
def label_udtf(spark, sf):
    label_function.register_label_udtf(spark)
    inputs.python_modules(spark, sf).select("file_path", "content").createOrReplaceTempView("vulnspark_label_files")
    return spark.sql("SELECT file_path, line, label FROM label_source(TABLE(vulnspark_label_files))")


@query
def snippet_heat(spark, sf):
    rows = localize.attribute_lines(inputs.with_token_scores(inputs.document_chunks(spark, sf)))
    cards = rows.select(
        F.concat_ws(":", "file_path", F.col("window_index").cast("string")).alias("id"),
        "start_line",
        "contributing_lines",
        text.snippet(F.col("code"), F.lit(1), F.col("end_line") - F.col("start_line") + 1).alias("code_snippet"),
    )
    return localize.snippet_heat(cards).select("id", "line", F.md5("text").alias("text_digest"), r6("score").alias("score"))


# --- hits and labels ---


def _hits(spark, sf) -> DataFrame:
    """Report hits, and secrets assigned in plain text as the second labeler."""
    lines = inputs.document_lines(spark, sf)
    keys = ["package", "file_path", "line"]
    sites = labeling.text_assignments(lines, keys, "line_text")
    secret = sites.filter(text.is_secret_literal(F.col("name"), F.col("value")))
    detected = secret.select(*keys, F.lit("HARDCODED_SECRET").alias("label"), F.col("pos").alias("ord"))
    return labeling.union_hits(inputs.digit_hits(spark, sf), detected)


@query
def all_hits(spark, sf):
    return _hits(spark, sf).select("package", "file_path", "line", "label", "labeler", "labeler_rank", "ord")


@query
def hits_in_chunks(spark, sf):
    found = labeling.hits_in_chunks(
        inputs.document_chunks(spark, sf), inputs.digit_hits(spark, sf), ["package", "file_path"]
    )
    return found.select("package", "file_path", "window_index", "line", "label")


@query
def hits_in_chunks_sweep(spark, sf):
    # The sweep carries every column it is given through its shuffles; the text is not asked for.
    chunks_ = inputs.document_chunks(spark, sf).select("package", "file_path", "window_index", "start_line", "end_line")
    found = sweep.hits_in_chunks(chunks_, inputs.digit_hits(spark, sf), ["package", "file_path"])
    return found.select("package", "file_path", "window_index", "line", "label")


FILE_KEYS = ["package", "file_path"]


@query
def label_chunks(spark, sf):
    # Chunks are read twice: once to find the hits inside, once to be labeled.
    stored = materialize(inputs.document_chunks(spark, sf, *inputs.LONG), work_folder(spark), "chunks")
    usable = labeling.usable_length(stored)
    labeled = labeling.label_chunks(usable, _hits(spark, sf), FILE_KEYS, [*FILE_KEYS, "start_byte"])
    return labeled.select(
        "file_path", "start_byte", "label", "labeler", F.col("vulnerable_lines")[0].alias("line")
    )


@query
def safe_sample(spark, sf):
    usable = labeling.usable_length(inputs.document_chunks(spark, sf, *inputs.LONG))
    kept = labeling.safe_chunks(
        usable, _hits(spark, sf), FILE_KEYS, "package", ["file_path", "start_byte"]
    )
    return kept.select("package", "file_path", "start_byte", "start_line", "end_line")


@query
def mined_records(spark, sf):
    files = inputs.python_modules(spark, sf).select(
        F.col("scan_id").alias("package"), "file_path", "content", F.lit("1.0").alias("version")
    )
    # The report knows the constant's line of every seventh file, and one line of its function.
    seventh = F.pmod(F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint"), F.lit(7)) == 0
    report = files.filter(seventh).select(
        "package", "file_path",
        F.explode(F.array(F.lit(2), F.lit(5))).alias("line"),
        F.lit("SQL_INJECTION").alias("label"),
    )
    records = labeling.mine_records(files, report.withColumn("ord", F.col("line")))
    return records.select(
        "repository_id", "file_path", "vulnerability_type", "start_line", "end_line",
        F.array_join(F.col("vulnerable_lines").cast("array<string>"), ",").alias("lines"),
        F.col("metadata")["labeler"].alias("labeler"),
        F.col("metadata")["function"].alias("function"),
    )


# --- splits and statistics ---


@query
def corpus_union(spark, sf):
    records = inputs.corpus_keys(spark, sf)
    both = corpus.union_corpora(
        records.filter("is_synthetic"), records.filter("not is_synthetic")
    )
    return both.select("doc_id", "repository_id", "source", "is_synthetic")


def _split_keys(spark, sf) -> DataFrame:
    return splits.make_splits(inputs.corpus_keys(spark, sf))


@query
def make_splits(spark, sf):
    return _split_keys(spark, sf).select("doc_id", "repository_id", "split", "in_test_real")


QUERIES["splits"] = QUERIES.pop("make_splits")


@query
def split_leakage(spark, sf):
    return splits.split_overlap(_split_keys(spark, sf))


@query
def split_summary(spark, sf):
    return splits.split_summary(_split_keys(spark, sf))


@query
def corpus_stats(spark, sf):
    return splits.corpus_stats(_split_keys(spark, sf))


@query
def repository_sketches(spark, sf):
    """Distinct files per split, exact and as estimated from stored sketches of two batches."""
    folder = work_folder(spark)
    records = _split_keys(spark, sf).withColumn("repository_id", F.col("file_path"))
    for odd in (0, 1):
        batch = records.filter(F.col("doc_id") % 2 == odd)
        splits.repository_sketches(batch).write.mode("append").parquet(f"{folder}/sketches")
    stored = splits.united_sketches(spark.read.parquet(f"{folder}/sketches"))
    exact = records.groupBy("split").agg(F.count_distinct("repository_id").alias("exact"))
    error = F.abs(F.col("n_repositories") - F.col("exact")) / F.col("exact")
    return exact.join(splits.estimated_repositories(stored), "split").select(
        "split", "exact", (error <= splits.sketch_error()).alias("within_bound")
    )


@query
def class_weights(spark, sf):
    # The third class is absent: its records carry the first one's label.
    label = F.when(F.col("doc_id") % 7 == 2, "SAFE").otherwise(F.col("vulnerability_type"))
    weights = splits.class_weights(inputs.corpus_keys(spark, sf).withColumn("vulnerability_type", label))
    return weights.withColumn("weight", r6("weight"))


@query
def labeled_docs(spark, sf):
    labels = inputs.table(spark, sf, "labels")
    records = inputs.corpus_keys(spark, sf).join(labels, "doc_id", "left")
    return records.groupBy("vulnerability_type").agg(
        F.count("*").alias("n"), F.count("quality").alias("n_labeled"),
        F.coalesce(F.sum("quality"), F.lit(0)).alias("n_good"),
    )


@query
def fit_pool(spark, sf):
    validation = _split_keys(spark, sf).filter(F.col("split") == "validation")
    return splits.fit_pool(validation).select("doc_id", "is_synthetic")


@query
def synthetic_share(spark, sf):
    return splits.synthetic_share(_split_keys(spark, sf), warn_over=0.4).withColumn(
        "synthetic_share", r6("synthetic_share")
    )


# --- evaluation ---


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@query
def confusion(spark, sf):
    return evaluate.confusion_matrix(inputs.labeled_pairs(spark, sf))


@query
def confusion_pivot(spark, sf):
    return evaluate.confusion_display(inputs.labeled_pairs(spark, sf))


@query
def per_class(spark, sf):
    return _rounded(evaluate.per_class_scores(inputs.labeled_pairs(spark, sf)))


@query
def metrics(spark, sf):
    return _rounded(evaluate.metrics(inputs.labeled_pairs(spark, sf)))


@query
def benchmark_table(spark, sf):
    return _rounded(evaluate.benchmark_table(inputs.labeled_pairs(spark, sf)))


@query
def ece(spark, sf):
    return _rounded(calibrate.expected_calibration_error(calibrate.scored(inputs.logits(spark, sf))))


@query
def reliability(spark, sf):
    return _rounded(calibrate.reliability_bins(calibrate.scored(inputs.logits(spark, sf))))


@query
def fit_temperature(spark, sf):
    return _rounded(calibrate.fit_temperature(inputs.logits(spark, sf)))


@query
def fit_temperature_newton(spark, sf):
    fitted = calibrate.fit_temperature_newton(inputs.logits(spark, sf))
    return _rounded(fitted.withColumn("flat", F.abs("gradient") < 1e-8).drop("gradient"))


@query
def calibration_transfer(spark, sf):
    sets = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("test_full"), F.lit("test_real")))
    rows = inputs.logits(spark, sf).withColumn(
        "set_name", F.explode(F.coalesce(sets, F.array(F.lit("test_full"))))
    )
    return _rounded(calibrate.calibration_transfer(rows, 1.65))


# --- localization ---


@query
def line_attribution(spark, sf):
    rows = localize.attribute_lines(inputs.with_token_scores(inputs.document_chunks(spark, sf)))
    lines = rows.select(
        "doc_id", "window_index", F.posexplode_outer("contributing_lines").alias("rank", "l")
    ).filter("l is not null")
    return lines.select(
        "doc_id", "window_index", "rank", "l.line", r6("l.score").alias("score"), F.md5("l.text").alias("text_digest")
    )


@query
def anchor_line(spark, sf):
    rows = localize.attribute_lines(inputs.with_token_scores(inputs.document_chunks(spark, sf)))
    return rows.select(
        "doc_id", "window_index",
        localize.anchor_line(F.col("contributing_lines"), F.col("start_line")).alias("anchor_line"),
    )


def _localized(spark, sf) -> DataFrame:
    """Ranked lines of each window against the lines of it that hold a digit."""
    ranked = localize.attribute_lines(inputs.with_token_scores(inputs.document_chunks(spark, sf)))
    predicted = ranked.select(
        "package", "file_path", "window_index", "doc_id", "start_line", "end_line",
        F.transform("contributing_lines", lambda a: a["line"]).alias("predicted_lines"),
    )
    keys = [*FILE_KEYS, "window_index"]
    inside = labeling.hits_in_chunks(predicted, inputs.digit_hits(spark, sf), FILE_KEYS)
    truth = inside.groupBy(*keys).agg(F.collect_set("line").alias("vulnerable_lines"))
    return predicted.join(truth, keys, "left").select(
        *keys, "doc_id", "predicted_lines",
        F.coalesce("vulnerable_lines", F.array().cast("array<int>")).alias("vulnerable_lines"),
        (F.col("doc_id") % 7).cast("int").alias("y_true"),
        F.when(F.col("doc_id") % 4 == 0, 0).otherwise((F.col("doc_id") % 7).cast("int")).alias("y_pred"),
    )


@query
def localization_topk(spark, sf):
    return _rounded(localize.localization_topk(_localized(spark, sf)))


@query
def localization_report(spark, sf):
    return _rounded(localize.localization_report(_localized(spark, sf)))


@query
def eval_sample(spark, sf):
    vulnerable = _split_keys(spark, sf).filter(F.size("vulnerable_lines") > 0)
    return localize.seeded_sample(vulnerable, "doc_id", limit=400, seed=42).select("doc_id", "vulnerability_type")


# --- reports ---


@query
def summary_by_severity(spark, sf):
    return dashboard.summary_by_severity(inputs.findings(spark, sf))


@query
def summary_by_type(spark, sf):
    return dashboard.summary_by_type(inputs.findings(spark, sf))


@query
def summary_by_file(spark, sf):
    return dashboard.summary_by_file(inputs.findings(spark, sf))


@query
def summary_totals(spark, sf):
    return _rounded(dashboard.summary_totals(inputs.findings(spark, sf), inputs.every_scan(spark, sf)))


@query
def dashboard_summary(spark, sf):
    return _rounded(dashboard.dashboard_summary(inputs.findings(spark, sf), inputs.every_scan(spark, sf)))


@query
def list_findings(spark, sf):
    rows, owners = inputs.findings(spark, sf), inputs.scans(spark, sf)
    page = dashboard.list_findings(rows, owners, 3, "s10", severity="high", limit=100, offset=5)
    return page.select("id", "scan_id", "file_path", "severity", "vulnerability_type", "confidence")


@query
def owned_findings(spark, sf):
    rows, owners = inputs.findings(spark, sf), inputs.scans(spark, sf)
    return dashboard.owned_findings(rows, owners, 3).select("id", "scan_id", "vulnerability_type")


@query
def list_scans(spark, sf):
    page = dashboard.list_scans(inputs.scans(spark, sf), 3, limit=20, offset=1)
    return page.select("id", "user_id", F.col("created_at").cast("string").alias("created_at"))


@query
def owned_finding(spark, sf):
    rows, owners = inputs.findings(spark, sf), inputs.scans(spark, sf)
    # The smallest id is looked up for every user; only the owner of its scan sees it.
    first = rows.agg(F.min("id").alias("id")).first()["id"]
    seen = [dashboard.owned_finding(rows, owners, user, first).withColumn("user_id", F.lit(user)) for user in range(7)]
    return reduce(DataFrame.unionByName, seen).select("user_id", "id", "scan_id", "severity")


@query
def with_remediation(spark, sf):
    # Every thirteenth finding carries a label that was retired.
    retired = F.when(F.col("start_line") % 13 == 0, "RETIRED").otherwise(F.col("vulnerability_type"))
    rows = inputs.findings(spark, sf).withColumn("vulnerability_type", retired)
    shown = dashboard.with_remediation(rows)
    return shown.groupBy("vulnerability_type", F.col("remediation.title").alias("title")).agg(
        F.count("*").alias("n")
    )


@query
def taxonomy(spark, sf):
    return dashboard.taxonomy(inputs.findings(spark, sf))


@query
def scan_counters(spark, sf):
    # Files of the first fifty scans only: the others have none.
    files = inputs.table(spark, sf, "orders").select(inputs.lit_concat("s", F.col("o_orderkey") % 50).alias("scan_id"))
    parts = inputs.table(spark, sf, "lineitem").select(lit_scan(F.col("l_orderkey")).alias("scan_id"))
    rows = inputs.findings(spark, sf)
    return dashboard.scan_counters(inputs.every_scan(spark, sf), files, parts, rows)


def lit_scan(key: Column) -> Column:
    return inputs.lit_concat("s", key % 60)


@query
def apply_dismissals(spark, sf):
    return dashboard.apply_dismissals(
        inputs.customer_findings(spark, sf), inputs.dismissals(spark, sf)
    )


@query
def retention(spark, sf):
    kept = dashboard.retain(inputs.findings(spark, sf), inputs.deletions(spark, sf))
    return kept.select("id", "scan_id")


@query
def retention_rewrite(spark, sf):
    """Deletes from a stored table and reads it back."""
    path = f"{work_folder(spark)}/findings"
    findings.clustered(inputs.findings(spark, sf), 16).write.parquet(path)
    rewriting.delete_scans(spark, path, inputs.deletions(spark, sf))
    return rewriting.read_current(spark, path).select("id", "scan_id")


@query
def scan_deletion(spark, sf):
    """Scans and findings after a deletion from both stored tables: findings left of each scan left."""
    folder = work_folder(spark)
    findings.clustered(inputs.findings(spark, sf), 16).write.parquet(f"{folder}/findings")
    findings.clustered(inputs.scans(spark, sf), 4, findings.SCANS_ORDER).write.parquet(f"{folder}/scans")
    rewriting.delete_scans(spark, f"{folder}/findings", inputs.deletions(spark, sf), f"{folder}/scans")
    left = rewriting.read_current(spark, f"{folder}/findings").groupBy("scan_id").agg(F.count("*").alias("n_findings"))
    kept = rewriting.read_current(spark, f"{folder}/scans").select(F.col("id").alias("scan_id"))
    return kept.join(left, "scan_id", "full")


@query
def apply_dismissals_bucketed(spark, sf):
    """The same on stored tables of equal buckets, after the log was appended to and compacted."""
    folder, tag = work_folder(spark), uuid.uuid4().hex
    rows = bucketed.store_findings(inputs.customer_findings(spark, sf), f"vulnspark_findings_{tag}", f"{folder}/findings", 8)
    log = inputs.dismissals(spark, sf)
    for part in (F.col("seq") % 2 == 0, F.col("seq") % 2 == 1):
        whole = bucketed.append_dismissals(log.filter(part), f"vulnspark_log_{tag}", f"{folder}/log", 8)
    compact = bucketed.compact_dismissals(whole, f"vulnspark_compact_{tag}", f"{folder}/compact", 8)
    return dashboard.apply_dismissals(rows, compact)


@query
def deep_findings_page(spark, sf):
    """A page far down one scan's list, from the stored order."""
    folder, rows = work_folder(spark), dashboard.active(inputs.findings(spark, sf))
    pages.write_pages(rows, folder, "scan_id", [F.col("confidence").desc(), F.col("id")])
    page = pages.read_page(spark, folder, "scan_id", "s10", limit=100, offset=40)
    return page.select("place", "id", "scan_id", "confidence")


@query
def deep_scans_page(spark, sf):
    folder = work_folder(spark)
    pages.write_pages(inputs.scans(spark, sf), folder, "user_id", [F.col("created_at").desc(), F.col("id")])
    return pages.read_page(spark, folder, "user_id", 3, limit=4, offset=2).select("place", "id", "user_id")


@query
def duplicate_keys(spark, sf):
    return dashboard.duplicate_locations(inputs.findings(spark, sf))


# --- scoring and scans ---


def _scored_logits(spark, sf) -> DataFrame:
    rows = inputs.logits(spark, sf)
    return rows.withColumns(
        {
            "scan_id": inputs.lit_concat("s", F.col("vec_id") % 5),
            "file_path": inputs.lit_concat("f", F.col("vec_id") % 40),
            "function_name": inputs.lit_concat("fn", F.col("vec_id") % 2),
            "start_line": (F.col("label") % 3).cast("int"),
            "probs": probability.softmax(F.col("logits")),
        }
    )


@query
def emit_findings(spark, sf):
    emitted = scan.emit_findings(scan.with_prediction(_scored_logits(spark, sf)), ["vec_id"])
    return emitted.select(
        "vec_id", "scan_id", "file_path", "function_name", "start_line", "label", "severity", r6("confidence").alias("confidence")
    )


@query
def merge_windows(spark, sf):
    windows = _scored_logits(spark, sf).withColumns(
        {"parent": F.floor(F.col("vec_id") / 4), "window_index": (F.col("vec_id") % 4).cast("int")}
    )
    merged = scan.with_prediction(scan.merge_windows(windows, ["parent"]))
    return merged.select("parent", "window_index", "label", r6("confidence").alias("confidence"), r6("vulnerable_mass").alias("vulnerable_mass"))


@query
def score_chunks(spark, sf):
    scored = scan.score_chunks(inputs.document_chunks(spark, sf), inputs.load_text_scorer)
    return scored.select(
        "doc_id", "window_index", *[r6(F.col("logits")[i]).alias(f"logit{i}") for i in range(7)]
    )


SCAN = {"temperature": 0.5, "max_tokens": inputs.MAX_TOKENS, "stride_tokens": inputs.STRIDE}


def _scan_modules(modules: DataFrame) -> DataFrame:
    pieces = chunks.chunk_files(modules, ["scan_id", "file_path"])
    return scan.scan_findings(
        pieces, inputs.load_text_scorer, token_scores=inputs.with_token_scores, **SCAN
    )


def _scan(spark, sf) -> DataFrame:
    return _scan_modules(inputs.python_modules(spark, sf))


def _plain_findings(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select(
        "scan_id", "file_path", "function_name", "vulnerability_type", "severity",
        F.round("confidence", 6).alias("confidence"), "confidence_calibrated",
        "start_line", "end_line", "anchor_line",
        F.size("contributing_lines").alias("n_lines"),
        F.round(F.col("probabilities")["SAFE"], digits).alias("p_safe"),
        F.md5("code_snippet").alias("snippet_digest"),
    )


@query
def scan_findings(spark, sf):
    return _plain_findings(_scan(spark, sf))


# --- near duplicates ---


@query
def minhash_sig(spark, sf):
    docs = inputs.documents(spark, sf).select("doc_id", "text")
    sigs = dedup.with_signature(docs, "text", num_perm=16, mode=dedup.SHA1)
    cells = sigs.select("doc_id", F.posexplode("signature").alias("i", "value"))
    # Unsigned values as 16 hex digits.
    return cells.select("doc_id", "i", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("value"))


@query
def lsh_pairs(spark, sf):
    return _rounded(dedup.leader_pairs(inputs.corpus(spark, sf), "doc_id", **DEDUP))


@query
def near_dup_pairs(spark, sf):
    return dedup.duplicate_pairs(inputs.corpus(spark, sf), "doc_id", **DEDUP)


@query
def dedup_kept(spark, sf):
    kept, _ = dedup.deduplicate(inputs.corpus(spark, sf), "doc_id", **DEDUP)
    return kept.select("doc_id", "is_synthetic")


@query
def dedup_kept_fast(spark, sf):
    """The default parameters: 128 hashes, 16 bands, vectorized hashing."""
    kept, _ = dedup.deduplicate(inputs.corpus(spark, sf), "doc_id")
    return kept.select("doc_id", "is_synthetic")


@query
def dedup_kept_full(spark, sf):
    """Full size with published hash values: 128 hashes, 16 bands."""
    kept, _ = dedup.deduplicate(inputs.corpus(spark, sf), "doc_id", mode=dedup.SHA1)
    return kept.select("doc_id", "is_synthetic")


@query
def corpus_build(spark, sf):
    records = inputs.corpus(spark, sf)
    parts = [records.filter("is_synthetic"), records.filter("not is_synthetic")]
    return build_corpus(parts, work_folder(spark), "doc_id", **DEDUP)


# --- classifier ---


def _classified(spark, sf) -> DataFrame:
    return splits.make_splits(inputs.corpus(spark, sf)).withColumn("y_true", (F.col("doc_id") % 7).cast("int"))


@query
def chosen_terms(spark, sf):
    """The forest's vocabulary."""
    train = _classified(spark, sf).filter(F.col("split") == "train")
    return classifier.choose_terms(classifier.with_terms(train), "y_true")


@query
def tfidf_weights(spark, sf):
    train = _classified(spark, sf).filter(F.col("split") == "train")
    return _rounded(classifier.tfidf_weights(train, "doc_id", "y_true"))


@query
def rf_baseline(spark, sf):
    """The forest at its default size: 300 trees."""
    records = _classified(spark, sf)
    train = records.filter(F.col("split") == "train")
    test = records.filter(F.col("split") == "test_full")
    model = classifier.train_forest(train)
    return _rounded(evaluate.metrics(classifier.predict(model, test), per_class=False))


@query
def rf_labels(spark, sf):
    """A forest of selected terms on given labels, toxic or not, measured on repositories it never saw."""
    known = inputs.table(spark, sf, "labels").filter("toxic IN (0, 1)")
    labels = known.select("doc_id", F.col("toxic").cast("int").alias("y_true"))
    records = splits.make_splits(inputs.corpus(spark, sf)).join(labels, "doc_id")
    model = classifier.train_selected_forest(records.filter(F.col("split") == "train"))
    test = classifier.predict(model, records.filter(F.col("split") == "test_full"))
    return _rounded(evaluate.metrics(test, per_class=False))


# --- streaming ---


@query
def stream_scan(spark, sf):
    documents = inputs.table(spark, sf, "documents")
    arriving = jobs.read_stream(spark, f"{sf}/documents*.parquet", documents.schema)
    docs = arriving.select("doc_id", "text", "lang", "source")

    def scan_batch(batch: DataFrame) -> DataFrame:
        return _scan_modules(inputs.modules_from(spread(batch)))

    return _plain_findings(jobs.stream_scan(docs, scan_batch, work_folder(spark)))


def _findings_stream(spark, sf) -> DataFrame:
    schema = inputs.table(spark, sf, "lineitem").schema
    return inputs.findings_from(jobs.read_stream(spark, f"{sf}/lineitem*.parquet", schema))


@query
def stream_dedup(spark, sf):
    arriving = _findings_stream(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    unique = jobs.stream_dedup(arriving, work_folder(spark), "36500 days")
    return unique.select("scan_id", "file_path", "function_name", "start_line")


@query
def stream_first_of_scan(spark, sf):
    arriving = _findings_stream(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    unique = jobs.stream_first_of_scan(arriving, work_folder(spark), "30 days")
    return unique.select("scan_id", "file_path", "function_name", "start_line")


@query
def stream_summary(spark, sf):
    return jobs.stream_summary(_findings_stream(spark, sf), work_folder(spark))

"""Sources, splits, metrics, calibration, localization, reports: hand-worked examples."""

from __future__ import annotations

import io
import json
import math
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from vulnspark.functions import text
from vulnspark.operators import calibrate, classifier, dashboard, evaluate, localize, splits
from vulnspark.sources import archives, corpus, findings, reports
from vulnspark.taxonomy import CWE_LABEL, LABELS, REMEDIATION, RULE_LABEL, SEVERITY, label_from_cwe

# --- taxonomy ---


def test_taxonomy_is_complete():
    assert LABELS[0] == "SAFE" and len(LABELS) == 7
    assert set(SEVERITY) == set(LABELS)
    assert set(REMEDIATION) == set(LABELS) - {"SAFE"}
    assert set(CWE_LABEL.values()) == set(LABELS) - {"SAFE"} and len(CWE_LABEL) == 15
    assert set(RULE_LABEL.values()) <= set(LABELS) and len(RULE_LABEL) == 17


def test_cwe_lookup_trims_and_ignores_case(spark):
    df = spark.createDataFrame([(" cwe-89 ",), ("CWE-79",), ("CWE-1",)], "c string")
    assert [r[0] for r in df.select(label_from_cwe(F.col("c"))).collect()] == ["SQL_INJECTION", "XSS", None]


# --- corpus ---


def record(repo="r", source="mined", synthetic=False, label="SAFE", code="x"):
    return (repo, "f.py", "python", code, label, 1, 2, source, synthetic, [1], {"k": "v"})


def records(spark, *rows):
    from vulnspark.schemas import CORPUS

    return spark.createDataFrame(list(rows), CORPUS)


def test_corpus_roundtrip_keeps_text_and_skips_blank_lines(spark, folder):
    rows = records(spark, record(code="é\n\t\"q\" \\   x"), record(repo="b", label="XSS"))
    assert corpus.write_corpus(rows, f"{folder}/deep/corpus") == 2
    back = corpus.read_corpus(spark, f"{folder}/deep/corpus")
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)
    with open(f"{folder}/blank.json", "w") as fh:
        fh.write("\n" + json.dumps({"repository_id": "a"}) + "\n\n")
    assert corpus.read_corpus(spark, f"{folder}/blank.json").count() == 1


def test_malformed_corpus_line_fails(spark, folder):
    with open(f"{folder}/bad.json", "w") as fh:
        fh.write('{"repository_id": "a", "start_line": "x"}\n{not json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        corpus.read_corpus(spark, f"{folder}/bad.json").collect()


def test_invariants(spark):
    rows = records(
        spark, record(), record(repo=""), record(synthetic=True), record(source="juliet"),
        record(source="juliet", synthetic=True), record(source="web"), record(label="NOPE"),
    )
    got = [r.violation for r in corpus.with_violation(rows).collect()]
    contradiction = "synthetic_flag_contradicts_source"
    assert got == [None, "missing_repository", contradiction, contradiction, None, "unknown_source", "unknown_label"]
    assert corpus.valid_records(rows).count() == 2
    with pytest.raises(Exception, match="missing_repository|contradicts|unknown"):
        corpus.valid_records(rows, strict=True).collect()


# --- reports ---


def test_cwe_report_takes_strings_and_lists(spark, folder):
    finding = lambda path, line, cwe: {"path": path, "start": {"line": line}, "extra": {"metadata": {"cwe": cwe}}}
    results = [
        finding("a.py", 3, "CWE-89: SQL"), finding("a.py", 3, ["CWE-79: x", "CWE-1: y", "CWE-22 and CWE-78"]),
        finding("b.py", 9, []), {"path": "c.py", "extra": {}}, {"extra": {"metadata": {"cwe": "CWE-502"}}},
    ]
    with open(f"{folder}/r.json", "w") as fh:
        json.dump({"results": results, "errors": []}, fh, indent=1)
    hits = reports.cwe_hits(reports.read_cwe_report(spark, f"{folder}/r.json"))
    assert sorted((r.path, r.line, r.label) for r in hits.collect()) == [
        ("", 0, "UNSAFE_DESERIALIZATION"),
        ("a.py", 3, "COMMAND_INJECTION"),
        ("a.py", 3, "PATH_TRAVERSAL"),
        ("a.py", 3, "SQL_INJECTION"),
        ("a.py", 3, "XSS"),
    ]
    open(f"{folder}/empty.json", "w").close()
    with pytest.raises(ValueError, match="no report"):
        reports.read_cwe_report(spark, f"{folder}/empty.json")


def test_rule_report_first_mapped_finding_wins(spark, folder):
    results = [{"filename": f, "test_id": t} for f, t in (("a", "B101"), ("a", "B608"), ("a", "B105"), ("b", "B101"))]
    with open(f"{folder}/r.json", "w") as fh:
        json.dump({"results": results}, fh)
    found = reports.read_rule_report(spark, f"{folder}/r.json")
    recs = spark.createDataFrame([("a",), ("b",), ("c",)], "filename string")
    assert sorted(map(tuple, reports.rule_predictions(recs, found, "filename").collect())) == [("a", 1), ("b", 0), ("c", 0)]


def test_popularity_list(spark, folder):
    with open(f"{folder}/top.json", "w") as fh:
        json.dump({"rows": [{"project": "boto3"}, "requests", {"project": ""}, {"other": 1}, "numpy"]}, fh)
    names = reports.top_names(reports.read_ranking(spark, f"{folder}/top.json"), 3)
    assert [r.name for r in names.collect()] == ["boto3", "requests", "numpy"]


# --- archives ---


def zipped(members: dict, symlink: str | None = None) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
        if symlink:
            info = zipfile.ZipInfo(symlink)
            info.external_attr = 0o120777 << 16
            z.writestr(info, "/etc/passwd")
    return buffer.getvalue()


def tarred(members: dict, link: str | None = None, fifo: str | None = None) -> bytes:
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        for name, kind in ((link, tarfile.SYMTYPE), (fifo, tarfile.FIFOTYPE)):
            if name:
                info = tarfile.TarInfo(name)
                info.type, info.linkname = kind, "/etc/passwd"
                t.addfile(info)
    return buffer.getvalue()


LIMITS = archives.Limits(20_000, 200_000, 20, 50.0, 5_000)


def test_archive_verdicts_and_selection(spark, folder):
    code = b"x = 1\n"
    noise = bytes(range(256)) * 120
    blobs = {
        "ok.zip": zipped({"p/a.py": code, "p/b.pyi": code, "p/.git/c.py": code, "node_modules/d.py": code, "R.md": b"r"}),
        "ok.tgz": tarred({"p/a.py": code, "p/bad.py": b"\xff\xfe\xfa", "p/big.py": b"#" * 6_000}),
        "traversal.zip": zipped({"a.py": code, "../evil.py": code}),
        "absolute.tgz": tarred({"/etc/evil.py": code}),
        "bomb.zip": zipped({"a.py": b"0" * 150_000}),
        "large.tgz": tarred({"a.py": b"0" * 250_000}),
        "many.zip": zipped({f"m{i}.py": code for i in range(21)}),
        "link.zip": zipped({"a.py": code}, symlink="l.py"),
        "link.tgz": tarred({"a.py": code}, link="l.py"),
        "fifo.tgz": tarred({"a.py": code}, fifo="f"),
        "plain.zip": b"just text, no archive",
        "none.zip": zipped({"README.md": b"hello"}),
        "upload.zip": zipped({"a.py": code}) + noise,
    }
    for name, blob in blobs.items():
        with open(f"{folder}/{name}", "wb") as fh:
            fh.write(blob)
    read = archives.read_archives(spark, folder, LIMITS)
    assert read.filter("content is null").count() == 1
    members = archives.archive_members(read)
    got = {r.archive.rsplit("/", 1)[1]: r.reason for r in archives.archive_verdicts(members, LIMITS).collect()}
    assert got == {
        "ok.zip": None,
        "ok.tgz": None,
        "traversal.zip": "unsafe_path",
        "absolute.tgz": "unsafe_path",
        "bomb.zip": "compression_ratio",
        "large.tgz": "too_large",
        "many.zip": "too_many_members",
        "link.zip": "link",
        "link.tgz": "link",
        "fifo.tgz": "unsupported_member",
        "plain.zip": "unsupported_format",
        "none.zip": "no_python_files",
        "upload.zip": "upload_too_large",
    }
    chosen = archives.select_sources(members, LIMITS).collect()
    assert sorted((r.name, r.running_bytes) for r in chosen if r.archive.endswith("ok.zip")) == [("p/a.py", 6), ("p/b.pyi", 12)]
    texts = archives.read_sources(read, LIMITS).collect()
    assert sorted((r.archive.rsplit(".", 1)[1], r.file_path) for r in texts) == [
        ("tgz", "p/a.py"), ("zip", "p/a.py"), ("zip", "p/b.pyi"),
    ]
    left = {(r.archive.rsplit("/", 1)[1], r.file_path): r.reason for r in archives.skipped_files(read, LIMITS).collect()}
    assert {k: v for k, v in left.items() if k[0].startswith("ok")} == {
        ("ok.zip", "p/.git/c.py"): "skipped_folder",
        ("ok.zip", "node_modules/d.py"): "skipped_folder",
        ("ok.tgz", "p/bad.py"): "not_utf8",
        ("ok.tgz", "p/big.py"): "file_too_large",
    }
    assert {k[0]: v for k, v in left.items() if k[1] is None} == {k: v for k, v in got.items() if v}


def test_damaged_and_encrypted_archives_are_refused_alone(spark):
    code = b"".join(b"x = %d\n" % i for i in range(200))
    good = zipped({"a.py": code})
    damaged, encrypted = bytearray(good), bytearray(good)
    at = good.index(b"a.py") + 4
    damaged[at + 20] ^= 0xFF
    for header in (b"PK\x03\x04", b"PK\x01\x02"):
        place = good.index(header) + (6 if header[2] == 3 else 8)
        encrypted[place] |= 1
    blobs = {"good": good, "damaged": bytes(damaged), "encrypted": bytes(encrypted), "cut": good[: len(good) // 2], "none": None}
    df = spark.createDataFrame([(k, len(v or b""), v) for k, v in blobs.items()], "archive string, upload_bytes bigint, content binary")
    assert [(r.archive, r.file_path) for r in archives.read_sources(df).collect()] == [("good", "a.py")]
    left = {r.archive: r.reason for r in archives.skipped_files(df).collect()}
    assert left == {"damaged": "unreadable", "encrypted": "unreadable", "cut": "unsupported_format", "none": "unsupported_format"}
    plan = archives.read_sources(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("MapInPandas") == 1 and "Exchange" not in plan


# --- limits that are gone ---


def test_running_totals_over_two_million_elements(spark):
    n = 2**21 + 5
    sums = text.prefix_sums(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: i * 0 + 1))
    row = spark.createDataFrame([(n,)], "n long").select(F.element_at(sums, -1).alias("last"), F.size(sums).alias("size")).first()
    assert (row.last, row.size) == (n, n)


def test_unknown_class_id_is_an_error(spark):
    rows = spark.createDataFrame([(0, 7), (0, 0)], "y_true int, y_pred int")
    with pytest.raises(Exception, match="no such class id: 0 7"):
        evaluate.confusion_matrix(rows).collect()


def test_temperature_beyond_the_first_grid(spark):
    rows = [([400.0 if k == i % 7 else 0.0 for k in range(7)], (i % 7 if i % 5 else (i + 1) % 7)) for i in range(200)]
    found = calibrate.fit_temperature_refined(spark.createDataFrame(rows, "logits array<double>, y_true int"))
    # Four of five rows are right: e^(400/T) / (e^(400/T) + 6) is 0.8.
    assert abs(found - 400 / math.log(24)) < 0.1
    same = spark.createDataFrame([([1.0] + [0.0] * 6, 0)], "logits array<double>, y_true int")
    with pytest.raises(ValueError, match="no temperature"):
        calibrate.fit_temperature_refined(same)


# --- splits ---


def test_splits_are_disjoint_and_stable(spark):
    rows = spark.range(600).select(
        F.concat(F.lit("repo"), (F.col("id") % 200).cast("string")).alias("repository_id"),
        F.when(F.col("id") % 200 < 100, "juliet").otherwise("mined").alias("source"),
        (F.col("id") % 200 < 100).alias("is_synthetic"),
        "id",
    )
    cut = splits.make_splits(rows)
    assert splits.straddling_repositories(cut).count() == 0
    assert {r.shared_repositories for r in splits.split_overlap(cut).collect()} == {0}
    real = cut.filter("in_test_real")
    assert real.count() > 0 and real.filter("is_synthetic or split <> 'test_full'").count() == 0
    alone = splits.make_splits(rows.filter("id % 2 = 0").orderBy(F.desc("id")))
    both = cut.select("id", "split").join(alone.select("id", F.col("split").alias("other")), "id")
    assert both.filter("split <> other").count() == 0
    share = cut.filter("split = 'test_full'").count() / 600
    assert 0.08 < share < 0.22


def test_class_weights_favor_rare_classes(spark):
    labels = [("SAFE",)] * 90 + [("SQL_INJECTION",)] * 10
    got = {r.label: r.weight for r in splits.class_weights(spark.createDataFrame(labels, "vulnerability_type string")).collect()}
    assert got["SQL_INJECTION"] == pytest.approx(9 * got["SAFE"]) and got["XSS"] == 0.0
    assert got["SAFE"] + got["SQL_INJECTION"] == pytest.approx(2.0)


@pytest.mark.parametrize("n_real, expected", [(49, 79), (50, 50)])
def test_fit_pool_needs_fifty_real_rows(spark, n_real, expected):
    rows = spark.createDataFrame([(i >= n_real,) for i in range(n_real + 30)], "is_synthetic boolean")
    assert splits.fit_pool(rows).count() == expected


# --- metrics ---


def test_metrics_by_hand(spark):
    pairs = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(2, 1)]
    df = spark.createDataFrame(pairs, "y_true int, y_pred int")
    m = evaluate.metrics(df, min_support=4).first()
    p0, r0, p1, r1 = 6 / 7, 6 / 8, 3 / 6, 3 / 4
    f = lambda p, r: 2 * p * r / (p + r)
    assert m.n == 13 and m.n_classes_supported == 2
    assert m.macro_f1 == pytest.approx((f(p0, r0) + f(p1, r1)) / 3)
    assert m.macro_f1_supported == pytest.approx((f(p0, r0) + f(p1, r1)) / 2)
    assert m.macro_precision == pytest.approx((p0 + p1) / 3) and m.macro_recall == pytest.approx((r0 + r1) / 3)
    assert m.accuracy == pytest.approx(9 / 13)
    assert m.false_positive_rate == pytest.approx(2 / 8)
    assert m.vulnerable_detection_rate == pytest.approx(4 / 5)
    assert (m.support_XSS, m.f1_XSS, m.support_PATH_TRAVERSAL) == (1, 0.0, 0)
    assert evaluate.confusion_matrix(df).count() == 49


def test_benchmark_covers_every_approach_and_caps_test_sets(spark):
    rows = [(a, s, i, i % 7, i % 7 if a == "forest" else 0) for a in ("forest", "rules") for s in ("full", "real") for i in range(30)]
    df = spark.createDataFrame(rows, "approach string, test_set string, record_id int, y_true int, y_pred int")
    timings = spark.createDataFrame([("forest", "full", 0.1)], "approach string, test_set string, seconds_per_sample double")
    table = {(r.approach, r.test_set): r for r in evaluate.benchmark_table(df, timings).collect()}
    assert len(table) == 4 and table["forest", "full"].seconds_per_sample == 0.1
    assert table["forest", "real"].macro_f1 == 1.0 and table["rules", "real"].vulnerable_detection_rate == 0.0
    assert {r.n for r in evaluate.benchmark_table(df, max_test=10).collect()} == {10}
    truth = df.filter("approach = 'rules' and test_set = 'full'")
    joined = evaluate.align(truth.select("record_id", "y_pred").orderBy(F.desc("record_id")), truth)
    assert joined.filter("y_true = record_id % 7").count() == 30


def test_metrics_without_safe_rows(spark):
    m = evaluate.metrics(spark.createDataFrame([(1, 0)], "y_true int, y_pred int")).first()
    assert (m.false_positive_rate, m.vulnerable_detection_rate, m.macro_f1_supported) == (0.0, 0.0, 0.0)


# --- calibration ---


def test_calibration_error_by_hand(spark):
    rows = [(0.0, 0.0), (1 / 15, 1.0), (0.5, 1.0), (0.52, 0.0), (1.0, 1.0)]
    df = spark.createDataFrame(rows, "confidence double, correct double")
    # Bins: none, 1, 8, 8, 15. The bin of 0.5 and 0.52 is off by 0.01, the first by 14/15.
    got = calibrate.expected_calibration_error(df).first()
    assert got.n == 5 and got.ece == pytest.approx((14 / 15 + 2 * 0.01) / 5)
    bins = calibrate.reliability_bins(df).orderBy("bin").collect()
    assert [b.n for b in bins] == [1, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0, 0, 1]
    assert bins[1].mean_confidence is None and bins[7].accuracy == 0.5


def test_refined_temperature_finds_the_minimum(spark):
    rows = [([3.0] + [0.0] * 6, 0)] * 7 + [([3.0] + [0.0] * 6, 1)] * 3
    df = spark.createDataFrame(rows, "logits array<double>, y_true int")
    t = calibrate.fit_temperature_refined(df)
    # At the best T the confidence of the first class equals its accuracy, 0.7.
    import math

    assert math.exp(3 / t) / (math.exp(3 / t) + 6) == pytest.approx(0.7, abs=1e-3)


def test_calibration_lookup_defaults_to_one(spark):
    scans = spark.createDataFrame([("a",), ("b",)], "model_version string")
    fitted = spark.createDataFrame([("a", 1.3)], "model_version string, temperature double")
    got = sorted(map(tuple, findings.with_temperature(scans, fitted).collect()))
    assert got == [("a", 1.3, True), ("b", 1.0, False)]


# --- localization ---


def test_line_attribution_by_hand(spark):
    code = "ab cd\n\nefgh \nij"
    tokens = [(0, 0.2), (3, 0.9), (7, 0.5), (13, 0.1), (99, 0.3)]
    df = spark.createDataFrame([(code, 10, tokens)], "code string, start_line int, token_scores array<struct<start:int,score:double>>")
    (row,) = localize.attribute_lines(df, top_k=None).collect()
    got = [(a.line, round(a.score, 6), a.text) for a in row.contributing_lines]
    assert got == [(10, 1.0, "ab cd"), (12, round(0.2 / 0.6, 6), "efgh"), (13, 0.0, "ij")]
    assert len(localize.attribute_lines(df, top_k=2).first().contributing_lines) == 2
    flat = df.withColumn("token_scores", F.expr("transform(token_scores, t -> named_struct('start', t.start, 'score', 0.4D))"))
    assert [a.score for a in localize.attribute_lines(flat).first().contributing_lines] == [1.0] * 3
    none = df.withColumn("token_scores", F.expr("filter(token_scores, t -> false)"))
    (row,) = localize.attribute_lines(none).select("*", localize.anchor_line(F.col("contributing_lines"), F.col("start_line")).alias("anchor")).collect()
    assert row.contributing_lines == [] and row.anchor == 10


def test_top_k_accuracy(spark):
    rows = [([3, 1], [1]), ([1], [1, 2]), ([2, 3, 4], []), ([], [5])]
    df = spark.createDataFrame(rows, "predicted_lines array<int>, vulnerable_lines array<int>")
    got = localize.localization_topk(df).first()
    assert tuple(got) == (4, 0.25, 0.5)
    assert localize.localization_topk(df.limit(0)).first().top_1_line_accuracy == 0.0


def test_seeded_sample_is_stable(spark):
    a = localize.seeded_sample(spark.range(100), "id", 10, 1).collect()
    b = localize.seeded_sample(spark.range(99, -1, -1).repartition(5), "id", 10, 1).collect()
    assert a == b != localize.seeded_sample(spark.range(100), "id", 10, 2).collect()


# --- reports over findings ---


def test_dashboard_hides_dismissed_and_foreign(spark):
    rows = [("1", "s", "f", "XSS", "MEDIUM", 0.9, False), ("2", "s", "f", "SQL_INJECTION", "CRITICAL", 0.7, False),
            ("3", "s", "g", "XSS", "MEDIUM", 0.5, True), ("4", "t", "g", "XSS", "MEDIUM", 0.5, True)]
    found = spark.createDataFrame(rows, "id string, scan_id string, file_path string, vulnerability_type string, severity string, confidence double, dismissed boolean")
    scans = spark.createDataFrame([("s", "u"), ("t", "v")], "id string, user_id string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(dashboard.list_findings(found, scans, "u", "s")) == ["1", "2"]
    assert ids(dashboard.list_findings(found, scans, "u", "s", include_dismissed=True, offset=1)) == ["2", "3"]
    assert ids(dashboard.list_findings(found, scans, "u", "s", severity="critical")) == ["2"]
    assert ids(dashboard.list_findings(found, scans, "u", "s", vulnerability_type="xss", file_path="f")) == ["1"]
    assert ids(dashboard.list_findings(found, scans, "v", "s")) == []
    assert ids(dashboard.owned_finding(found, scans, "u", "2")) == ["2"]
    assert ids(dashboard.owned_finding(found, scans, "v", "2")) == []
    assert dashboard.owned_scan(scans, "v", "s").count() == 0
    with pytest.raises(ValueError, match="limit"):
        dashboard.list_findings(found, scans, "u", "s", limit=1001)
    (top,) = dashboard.summary_by_file(found).collect()
    assert (top.file_path, top["count"], top.highest_severity) == ("f", 2, "CRITICAL")
    totals = {r.scan_id: (r.total_findings, r.mean_confidence) for r in dashboard.summary_totals(found, found.select(F.col("scan_id").alias("id")).distinct()).collect()}
    assert totals["s"] == (2, pytest.approx(0.8)) and totals["t"] == (0, None)
    assert dashboard.summary_by_severity(found).orderBy(F.desc("rank")).first().severity == "CRITICAL"
    advice = {r.id: r.remediation for r in dashboard.with_remediation(found.withColumn("vulnerability_type", F.when(F.col("id") == "1", "GONE").otherwise(F.col("vulnerability_type")))).collect()}
    assert advice["1"] is None and advice["2"].title


def test_later_dismissal_wins(spark):
    found = spark.createDataFrame([("1", False, None), ("2", True, "old"), ("3", False, None)], "id string, dismissed boolean, dismissed_reason string")
    log = spark.createDataFrame([("1", "first", 1, 1), ("1", "second", 1, 2), ("9", "x", 1, 3)], "finding_id string, reason string, at int, seq int")
    got = {r.id: (r.dismissed, r.dismissed_reason) for r in dashboard.apply_dismissals(found, log).collect()}
    assert got == {"1": (True, "second"), "2": (True, "old"), "3": (False, None)}


def test_findings_sink_rounds_and_reads_back(spark, folder):
    df = spark.sql(
        "SELECT 'i' id, 's' scan_id, 'f' file_path, 'n' function_name, 'XSS' vulnerability_type, 'MEDIUM' severity, 0.123456D confidence,"
        " true confidence_calibrated, 1 start_line, 2 end_line, 1 anchor_line,"
        " array(named_struct('line', 1, 'score', 0.987654D, 'text', 't')) contributing_lines, map('XSS', 0.333333D) probabilities,"
        " 'c' code_snippet, false dismissed, CAST(NULL AS STRING) dismissed_reason, timestamp'2024-01-01 00:00:00' created_at"
    )
    findings.write_findings(df, f"{folder}/findings")
    (row,) = findings.read_findings(spark, f"{folder}/findings").collect()
    assert (row.contributing_lines[0].score, row.probabilities["XSS"], row.confidence) == (0.9877, 0.3333, 0.123456)


def test_forest_learns_separable_text(spark):
    rows = [(f"cursor execute {i} SELECT FROM users", 1) for i in range(20)] + [(f"return sum of {i} items", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "code string, y_true int")
    model = classifier.train_forest(df, trees=5, max_depth=4, max_features=200)
    scored = classifier.predict(model, df)
    assert scored.filter("y_pred <> y_true").count() == 0
    assert "weight" not in scored.columns

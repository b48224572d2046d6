"""Explicit schemas of the engine's tables. Nothing is inferred."""

CORPUS = (
    "repository_id string, file_path string, language string, code string, "
    "vulnerability_type string, start_line int, end_line int, source string, "
    "is_synthetic boolean, vulnerable_lines array<int>, metadata map<string,string>"
)

CHUNKS = (
    "name string, code string, start_line int, end_line int, start_byte bigint, "
    "end_byte bigint, window_index int, window_count int, metadata map<string,string>"
)

LINE_SCORES = "array<struct<line:int,score:double,text:string>>"

FINDINGS = (
    "id string, scan_id string, file_path string, function_name string, "
    "vulnerability_type string, severity string, confidence double, "
    "confidence_calibrated boolean, start_line int, end_line int, anchor_line int, "
    f"contributing_lines {LINE_SCORES}, probabilities map<string,double>, "
    "code_snippet string, dismissed boolean, dismissed_reason string, created_at timestamp"
)

SCANS = (
    "id string, user_id string, repository_name string, status string, model_version string, "
    "parser_backend string, files_scanned int, functions_scanned int, findings_count int, "
    "duration_seconds double, error string, created_at timestamp, started_at timestamp, "
    "completed_at timestamp"
)

# A static-analysis report with CWE metadata; `cwe` is a string or a list of strings.
CWE_REPORT = (
    "results array<struct<path:string, start:struct<line:int>, "
    "extra:struct<metadata:struct<cwe:string>>>>"
)

# A rule-scanner report.
RULE_REPORT = "results array<struct<filename:string, test_id:string>>"

SOURCES = ("cvefixes", "juliet", "mined")
SYNTHETIC_SOURCES = ("juliet",)

ARCHIVES = "archive string, upload_bytes bigint, content binary"
ARCHIVE_MEMBERS = (
    "archive string, format string, upload_bytes bigint, member_index int, name string, "
    "kind string, size bigint, compressed bigint"
)

"""The fixed vulnerability taxonomy, as lookup expressions and small dimension tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class names, in model output order.
LABELS = (
    "SAFE",
    "SQL_INJECTION",
    "XSS",
    "PATH_TRAVERSAL",
    "COMMAND_INJECTION",
    "UNSAFE_DESERIALIZATION",
    "HARDCODED_SECRET",
)
NUM_LABELS = len(LABELS)
LABEL_ID = {name: i for i, name in enumerate(LABELS)}

# Severity of each class.
SEVERITY = {
    "SAFE": "NONE",
    "SQL_INJECTION": "CRITICAL",
    "XSS": "MEDIUM",
    "PATH_TRAVERSAL": "HIGH",
    "COMMAND_INJECTION": "CRITICAL",
    "UNSAFE_DESERIALIZATION": "HIGH",
    "HARDCODED_SECRET": "HIGH",
}
SEVERITY_RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

# CWE id to class.
CWE_LABEL = {
    "CWE-22": "PATH_TRAVERSAL",
    "CWE-23": "PATH_TRAVERSAL",
    "CWE-36": "PATH_TRAVERSAL",
    "CWE-77": "COMMAND_INJECTION",
    "CWE-78": "COMMAND_INJECTION",
    "CWE-79": "XSS",
    "CWE-80": "XSS",
    "CWE-88": "COMMAND_INJECTION",
    "CWE-89": "SQL_INJECTION",
    "CWE-116": "XSS",
    "CWE-259": "HARDCODED_SECRET",
    "CWE-321": "HARDCODED_SECRET",
    "CWE-502": "UNSAFE_DESERIALIZATION",
    "CWE-564": "SQL_INJECTION",
    "CWE-798": "HARDCODED_SECRET",
}

# Rule-scanner test id to class.
RULE_LABEL = {
    "B105": "HARDCODED_SECRET",
    "B106": "HARDCODED_SECRET",
    "B107": "HARDCODED_SECRET",
    "B108": "PATH_TRAVERSAL",
    "B301": "UNSAFE_DESERIALIZATION",
    "B302": "UNSAFE_DESERIALIZATION",
    "B403": "UNSAFE_DESERIALIZATION",
    "B506": "UNSAFE_DESERIALIZATION",
    "B602": "COMMAND_INJECTION",
    "B603": "COMMAND_INJECTION",
    "B604": "COMMAND_INJECTION",
    "B605": "COMMAND_INJECTION",
    "B606": "COMMAND_INJECTION",
    "B607": "COMMAND_INJECTION",
    "B608": "SQL_INJECTION",
    "B610": "SQL_INJECTION",
    "B611": "SQL_INJECTION",
}

# Advice shown next to a finding: title, explanation, unsafe form, safe form.
REMEDIATION = {
    "SQL_INJECTION": (
        "Bind values instead of building SQL text",
        "Text glued into a statement can change what the statement does. "
        "Bound parameters travel apart from it and stay plain values.",
        'db.execute("DELETE FROM cart WHERE owner = " + owner)',
        'db.execute("DELETE FROM cart WHERE owner = ?", [owner])',
    ),
    "XSS": (
        "Escape output for the place it lands in",
        "Unescaped input in a page runs as script in the reader's browser. "
        "Render through a template engine with escaping switched on.",
        'return "<p>" + comment + "</p>"',
        'return render_template("comment.html", comment=comment)',
    ),
    "PATH_TRAVERSAL": (
        "Check that a path stays inside its base folder",
        "A name holding '..' or a leading slash can reach any readable file. "
        "Resolve the full path and refuse it unless the base folder contains it.",
        'open("/data/" + name)',
        "path = (BASE / name).resolve(); path.relative_to(BASE); path.open()",
    ),
    "COMMAND_INJECTION": (
        "Run programs from an argument list, without a shell",
        "A shell treats ; | and $() inside input as further commands. "
        "An argument list hands each value to the program unread.",
        'os.system("convert " + name)',
        'subprocess.run(["convert", name], check=True)',
    ),
    "UNSAFE_DESERIALIZATION": (
        "Read untrusted bytes with a data-only format",
        "Object loaders can call code named by the bytes they load. "
        "JSON and safe YAML loaders only ever produce plain data.",
        "state = pickle.loads(body)",
        "state = json.loads(body)",
    ),
    "HARDCODED_SECRET": (
        "Take credentials from the environment or a secret store",
        "A credential in source is visible to everyone who can read the history. "
        "Rotate it, and load its replacement when the program starts.",
        'API_KEY = "9f8e7d6c5b4a39281706"',
        'API_KEY = os.environ["API_KEY"]',
    ),
}


def lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup: null when the key is unknown, and never a join."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(mapping.items()))), key)


def label_name(label_id: Column) -> Column:
    return lookup(dict(enumerate(LABELS)), label_id.cast("int"))


def label_id(name: Column) -> Column:
    return lookup(LABEL_ID, name)


def severity_for(label: Column) -> Column:
    return lookup(SEVERITY, label)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, severity), F.lit(0))


def severity_of_rank(rank: Column) -> Column:
    return lookup({v: k for k, v in SEVERITY_RANK.items()}, rank)


def label_from_cwe(cwe: Column) -> Column:
    return lookup(CWE_LABEL, F.upper(F.trim(cwe)))


def label_from_rule(test_id: Column) -> Column:
    return lookup(RULE_LABEL, test_id)


def label_dim(spark: SparkSession) -> DataFrame:
    """label_id, label, severity, has_remediation: seven rows, always."""
    rows = [(i, n, SEVERITY[n], n in REMEDIATION) for i, n in enumerate(LABELS)]
    return spark.createDataFrame(
        rows, "label_id int, label string, severity string, has_remediation boolean"
    )


def remediation_dim(spark: SparkSession) -> DataFrame:
    """vulnerability_type and its advice: six rows, always."""
    rows = [(name, *texts) for name, texts in REMEDIATION.items()]
    return spark.createDataFrame(
        rows,
        "vulnerability_type string, title string, explanation string, "
        "unsafe_example string, safe_example string",
    )

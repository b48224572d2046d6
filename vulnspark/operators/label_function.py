"""The labeler as a table function for SQL: label_source(TABLE(files)).

The function takes any table with a `content` column. Its other columns come back with every label,
so files keep whatever names them. Rows are independent, so the table is not dealt anew; PARTITION BY
is accepted where a caller wants it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vulnspark.functions import text as rules
from vulnspark.operators.source import facts

SECRET, TRAVERSAL = "HARDCODED_SECRET", "PATH_TRAVERSAL"
CONTENT = "content"


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_secret(name: str, value: str) -> bool:
    """`functions.text.is_secret_literal` for one pair."""
    if value.strip().lower() in rules.PLACEHOLDERS or len(value) < rules.MIN_VALUE:
        return False
    if re.search(rules.SECRET_VALUE, value):
        return True
    if not re.search(rules.SECRET_NAME, name) or any(c.isspace() for c in value):
        return False
    if sum(c.isalnum() for c in value) / len(value) < rules.MIN_ALNUM:
        return False
    return len(value) >= rules.MIN_OPAQUE and _entropy(value) >= rules.MIN_ENTROPY


def opened_lines(function: dict) -> list[int]:
    """Lines of an unguarded function where a path from outside is opened."""
    if function["guards"]:
        return []
    outside = set(function["parameters"])
    for bound in function["sets"]:
        if bound["request"] or not outside.isdisjoint(bound["reads"]):
            outside.add(bound["name"])
    paths = [s for s in function["sets"] if s["builds"] and not outside.isdisjoint(s["reads"])]
    return [
        o["line"]
        for o in function["opens"]
        if not outside.isdisjoint(o["reads"]) or any(s["name"] == o["name"] and s["at"] < o["at"] for s in paths)
    ]


def labels(content: str | None) -> list[tuple[int, str]]:
    """(line, label) of one file; a secret wins a shared line."""
    found = facts(content, "functions")
    secret = {s["line"] for s in found["literals"] if any(looks_secret(n, s["value"]) for n in s["names"])}
    opened = {line for f in found["functions"] for line in opened_lines(f)} - secret
    return [(line, SECRET) for line in sorted(secret)] + [(line, TRAVERSAL) for line in sorted(opened)]


class LabelSource:
    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable or CONTENT not in files.dataType.fieldNames():
            raise ValueError(f"label_source takes a table with a {CONTENT} column")
        kept = [f for f in files.dataType.fields if f.name != CONTENT]
        taken = {"line", "label"} & {f.name for f in kept}
        if taken:
            raise ValueError(f"columns {sorted(taken)} of the table would be hidden by the labels")
        return AnalyzeResult(schema=T.StructType(kept).add("line", T.IntegerType()).add("label", T.StringType()))

    def eval(self, row: T.Row) -> Iterator[tuple]:
        values = row.asDict(recursive=False)
        content = values.pop(CONTENT)
        for line, label in labels(content):
            yield (*values.values(), line, label)


def register_label_udtf(spark: SparkSession, name: str = "label_source") -> None:
    spark.udtf.register(name, F.udtf(LabelSource))

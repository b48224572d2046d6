"""Predicates over archive member names and source paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders a scan never enters.
SKIP_DIRECTORIES = (
    ".eggs", ".git", ".hg", ".mypy_cache", ".pytest_cache", ".svn", ".tox", ".venv",
    "__pycache__", "build", "dist", "env", "node_modules", "site-packages", "venv",
)
# Path parts mining leaves out, compared in lower case.
MINING_SKIP = (
    "_test", "_vendor", "benchmark", "benchmarks", "conftest", "docs", "example",
    "examples", "setup", "test", "testing", "tests", "vendor", "vendored",
)


def parts(name: Column) -> Column:
    """Path parts, with backslashes read as separators and empty parts dropped."""
    return F.filter(F.split(F.translate(name, "\\", "/"), "/"), lambda p: ~p.isin("", "."))


def is_safe_member(name: Column) -> Column:
    """Non-empty, not absolute, no drive letter, no parent part."""
    rooted = name.rlike(r"^[/\\]") | (F.substring(name, 2, 1) == ":")
    return (name != "") & ~rooted & ~F.array_contains(parts(name), "..")


def in_skipped_directory(name: Column) -> Column:
    return F.arrays_overlap(parts(name), F.lit(list(SKIP_DIRECTORIES)))


def is_python_file(name: Column) -> Column:
    return name.rlike(r"(^|/)[^/]+\.pyi?$")


def is_mining_file(name: Column) -> Column:
    """A `.py` file outside test, doc and vendored folders, relative to its package."""
    lowered = F.transform(parts(name), F.lower)
    return (
        name.endswith(".py")
        & is_safe_member(name)
        & ~F.arrays_overlap(lowered, F.lit(list(MINING_SKIP)))
    )

"""Text expressions: lines, tokens, shingles, entropy, secrets, snippets.

All are built-in expressions, so they run in the JVM next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and digits are spelled out because the JVM's \s and \d are ASCII-only.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
TOKEN = rf"[A-Za-z_][A-Za-z0-9_]*|\p{{Nd}}+|[^A-Za-z0-9_\p{{Nd}}{SPACE}]"
# The classifier's tokens: bare digit runs vanish.
TOKEN_ML = rf"[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z0-9_{SPACE}]"

BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
_NOT_BREAK = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
LINE_WITH_BREAK = rf"{_NOT_BREAK}*(?:{BREAK})|{_NOT_BREAK}+"

# Names that suggest a credential.
SECRET_NAME = (
    r"(?i)(api[_-]?key|secret|password|passwd|pwd|token|credential|auth|"
    r"access[_-]?key|private[_-]?key|client[_-]?secret|bearer)"
)
# Credential formats that are conclusive whatever the name.
SECRET_VALUE = (
    r"^(sk_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|"
    r"ghp_[A-Za-z0-9]{36}|gho_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|"
    r"AIza[0-9A-Za-z_-]{35}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)
# Placeholders, never credentials.
PLACEHOLDERS = (
    "", "*", "**", "***", "<your key>", "changeme", "dummy", "example", "fake", "none",
    "null", "password", "placeholder", "redacted", "sample", "secret", "test", "todo",
    "token", "xxx", "your_api_key_here",
)
MIN_VALUE, MIN_OPAQUE, MIN_ALNUM, MIN_ENTROPY = 8, 16, 0.8, 3.4


def let(value: Column, body) -> Column:
    """Bind `value` once. An expression named inside a lambda is otherwise evaluated again
    for every element the lambda visits."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubling_steps(values: Column) -> Column:
    """1, 2, 4, ... up to at least half the array's size, however large it is."""
    last = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.pow(F.lit(2.0), k).cast("int"))


def prefix_sums(values: Column) -> Column:
    """Inclusive running totals of a numeric array, by doubling steps: n log n work.

    Appending totals one by one inside `aggregate` would copy the array for every element.
    """

    def reach(v: Column, step: Column) -> Column:
        summed = F.transform(v, lambda x, i: x + F.coalesce(F.get(v, i - step), F.lit(0)))
        return F.when(F.size(v) <= step, v).otherwise(summed)

    return let(values, lambda own: F.aggregate(_doubling_steps(own), own, reach))


def probe_steps(ascending: Column) -> Column:
    """The steps `last_at_most` takes over this array, largest first."""
    return F.filter(F.reverse(_doubling_steps(ascending)), lambda step: step < F.size(ascending))


def last_at_most(ascending: Column, steps: Column, value: Column) -> Column:
    """0-based index of the last element <= value (0 if there is none), by binary search."""

    def probe(at: Column, step: Column) -> Column:
        fits = F.coalesce(F.get(ascending, at + step) <= value, F.lit(False))
        return F.when(fits, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), probe)


def fingerprint(code: Column) -> Column:
    return F.substring(F.sha2(code, 256), 1, 16)


def tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))


def tokens_ml(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(TOKEN_ML), F.lit(0))


def shingles(toks: Column, k: int = 5) -> Column:
    """The set of k-token runs; a shorter list is one shingle, an empty list none."""

    def runs(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1)))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.transform(starts, lambda j: F.array_join(F.slice(t, j, k), " ")))
        )

    return let(toks, runs)


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a final break opens no further line."""

    def drop_last_empty(parts: Column) -> Column:
        closed = F.element_at(parts, -1) == ""
        return F.when(closed, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return let(F.split(text, BREAK), drop_last_empty)


def split_lines_keep(text: Column) -> Column:
    """Lines with their breaks, so that joining them gives the text back."""
    return F.regexp_extract_all(text, F.lit(LINE_WITH_BREAK), F.lit(0))


def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty text."""

    def entropy(chars: Column) -> Column:
        # Sorted, equal characters are runs; a run's length is the distance of its end to the last one's.
        n = F.size(chars)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.get(chars, i).eqNullSafe(F.get(chars, i - 1)))

        def total(at: Column) -> Column:
            share = F.transform(at, lambda end, i: (end - F.coalesce(F.get(at, i - 1), F.lit(0))) / n)
            return F.aggregate(share, F.lit(0.0), lambda sum_, p: sum_ - p * F.log2(p))

        return F.when(n == 0, F.lit(0.0)).otherwise(let(ends, total))

    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(text.isNull(), F.lit(None).cast("double")).otherwise(let(chars, entropy))


def alnum_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / F.length(text)


def is_secret_literal(name: Column, value: Column) -> Column:
    """Does a string bound to this name look like a real credential?"""
    trimmed = F.lower(F.regexp_replace(value, rf"^[{SPACE}]+|[{SPACE}]+$", ""))
    return (
        F.when(trimmed.isin(*PLACEHOLDERS) | (F.length(value) < MIN_VALUE), F.lit(False))
        .when(value.rlike(SECRET_VALUE), F.lit(True))
        .when(~name.rlike(SECRET_NAME), F.lit(False))
        .when(value.rlike(f"[{SPACE}]"), F.lit(False))
        .when(alnum_share(value) < MIN_ALNUM, F.lit(False))
        .otherwise((F.length(value) >= MIN_OPAQUE) & (char_entropy(value) >= MIN_ENTROPY))
    )


def line_of_offset(code: Column, start_line: Column, offset: Column) -> Column:
    """Absolute line holding a byte offset of the chunk; negatives mean the first line."""
    lines = F.split(code, "\n")
    ended = F.slice(lines, 1, F.size(lines) - 1)
    state = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("passed"))

    def step(acc, line):
        pos = acc["pos"] + F.octet_length(line) + 1
        passed = acc["passed"] + F.when(pos <= offset, 1).otherwise(0)
        return F.struct(pos.alias("pos"), passed.alias("passed"))

    return start_line + F.aggregate(ended, state, step, lambda acc: acc["passed"])


def snippet(source: Column, start_line: Column, end_line: Column, max_lines: int = 40) -> Column:
    """The lines of one function only, cut at `max_lines` with a note of the rest."""
    total = end_line - start_line + 1
    kept = F.slice(split_lines(source), start_line, F.greatest(F.least(total, F.lit(max_lines)), F.lit(0)))
    note = F.concat(F.lit("... ("), (total - max_lines).cast("string"), F.lit(" more lines)"))
    return F.array_join(
        F.when(total > max_lines, F.concat(kept, F.array(note))).otherwise(kept), "\n"
    )

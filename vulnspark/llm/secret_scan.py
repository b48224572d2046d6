"""Secrets in texts by assignment-aware lexing.

Three base patterns are found wherever they stand. Beyond them, every `name = literal` of
source or configuration syntax (=, :, :=, =>, with or without quotes, joined by +, in nested
braces) is parsed into a pair, names assigned from other names pass their literals on, and a literal is reported when the
names it reaches are sensitive enough for how random it looks.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import rows, text_of

KINDS = ("assign", "access", "hex", "literal")
#: Fixed patterns; a match that is too short is dropped after it was matched.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_NAMES = ("passw", "secret", "token", "apikey", "api_key")

OPERATOR = re.compile(r":=|=>|(?<![=!<>:])=(?!=)|:(?![:/])")
VALUE = re.compile(
    r"[ \t]*(?:[rbuf]{0,2}(?P<quote>\"\"\"|'''|\"|'|`)(?P<text>.*?)(?<!\\)(?P=quote)|(?P<name>[A-Za-z_][\w.]*)(?![\w+/=-])|(?P<bare>[\w+/.=\-]+))",
    re.DOTALL,
)
BRACE = re.compile(r"[{}]")
#: A value that is an object or block with names of its own.
OPENED = re.compile(r"\s*\{")
PLUS = re.compile(r"[ \t]*\+\s*(?=[\"'`\w])")
#: So many names around one count as its own.
NESTED = 4
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How far a part of a name makes its literal a secret; the rest of the score is randomness.
SENSITIVE = {
    "apikey": 1.0, "auth": 0.5, "authorization": 0.7, "bearer": 0.6, "cert": 0.4, "credential": 0.9,
    "credentials": 0.9, "cookie": 0.4, "encryption": 0.5, "jwt": 0.8, "key": 0.4, "passphrase": 1.0, "passwd": 1.0,
    "password": 1.0, "pass": 0.7, "private": 0.5, "pwd": 1.0, "salt": 0.5, "secret": 1.0, "session": 0.3,
    "signing": 0.5, "token": 0.9, "webhook": 0.4, "access": 0.4, "api": 0.3, "client": 0.2,
}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+)$|changeme|example|placeholder|your[_-]?|dummy|sample|<.*>|\$\{|\{\{|^(?:true|false|none|null)$", re.IGNORECASE)
LEAST_SCORE = 1.5
LEAST_LENGTH = 8


def name_score(name: str) -> float:
    return min(1.0, sum(SENSITIVE.get(p.lower(), 0.0) for p in NAME_PART.findall(name)))


def literal_score(literal: str) -> float:
    """0 for what is no secret; up to 1 with length, character kinds and entropy."""
    if len(literal) < LEAST_LENGTH or PLACEHOLDER.search(literal) or any(c.isspace() for c in literal):
        return 0.0
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w]"))
    return min(1.0, entropy / 4 * 0.7 + (kinds - 1) * 0.3) if kinds > 1 else min(0.5, entropy / 8)


def _name_before(text: str, end: int) -> str:
    """The name, quoted or not, that ends before this place on its line."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'`]":
        end -= 1
        if end and text[end - 1] in "\"'`":
            end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
        start -= 1
    name = text[start:end].strip(".-")
    return "" if name[:1].isdigit() else name


def pairs(text: str) -> Iterator[tuple[str, str, int, int, list[str]]]:
    """(name, literal, start, end, names) of every assignment, in order.

    Constants joined by + are one literal from the first to the last; `names` are the names among
    the parts. A name inside braces that a name opens is written behind that one, with a dot."""
    open_: list[str] = []
    done = 0
    for op in OPERATOR.finditer(text):
        for brace in BRACE.finditer(text, done, op.start()):
            if brace[0] == "{":
                open_.append("")
            elif open_:
                open_.pop()
        done = max(done, op.start())
        name = _name_before(text, op.start())
        if not name:
            continue
        path = ".".join([*filter(None, open_[-NESTED:]), name])
        opened = OPENED.match(text, op.end())
        if opened:
            open_.append(name)
            done = opened.end()
            continue
        literal, names, first, last, at = [], [], -1, -1, op.end()
        while value := VALUE.match(text, at):
            group = "text" if value["quote"] else "name" if value["name"] else "bare"
            first, last = value.start(group) if first < 0 else first, value.end(group)
            if group == "name":
                names.append(value["name"])
            literal.append(value[group])
            plus = PLUS.match(text, value.end())
            if not plus:
                break
            at = plus.end()
        if first >= 0:
            yield path, "".join(literal), first, last, names


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals that reach a sensitive name, in order. A name that is
    assigned from another takes over its literals, through any number of steps.

    Names are visited from the most sensitive one on, each name once, by the first that reaches it:
    that one is its best, and the work is linear in the assignments."""
    if "=" not in text and ":" not in text:
        return []
    own: dict[str, dict[tuple[int, int], str]] = defaultdict(dict)
    taken: dict[str, set[str]] = defaultdict(set)
    for name, value, start, end, names in pairs(text):
        taken[name].update(names)
        # An unquoted word is a name in source and a literal in configuration.
        own[name][start, end] = value
    scores = {name: name_score(name) for name in own}
    best: dict[str, str] = {}
    for target in sorted((n for n, s in scores.items() if s > 0), key=lambda n: (-scores[n], n)):
        todo = [target]
        while todo:
            name = todo.pop()
            if name not in best:
                best[name] = target
                todo.extend(taken.get(name, ()))
    found: dict[tuple[int, int], tuple[float, str]] = {}
    for name, target in best.items():
        for place, value in own.get(name, {}).items():
            score = scores[target] + literal_score(value) if value not in own else 0.0
            if score >= LEAST_SCORE:
                # Of equal scores the alphabetically first name.
                found[place] = min(found.get(place, (-score, target)), (-score, target))
    return [(start, end, found[start, end][1], -found[start, end][0]) for start, end in sorted(found)]


def spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, name, score) by start, then kind: whole matches of the base patterns, and
    literals that no base span touches. Positions count code points, ends are exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in ASSIGN_NAMES):
        found += [("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    base = [(s, e) for _, s, e, _, _ in found]
    found += [("literal", s, e, name, x) for s, e, name, x in literals(text) if all(e <= a or s >= b for a, b in base)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in SPAN]
    for batch in batches:
        found = [[dict(zip(names, s, strict=True)) for s in spans(text)] for _, text in rows(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, name, score) of the whole text.

    Null and empty texts have no spans; very long ones are read whole, in linear time. Ids are passed
    on as they are, null and repeated ones too; other columns are not read; an empty table gives no rows. One pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,name:string,score:double>>"
    return docs.select(F.col(id_col), text_of(text_col)).mapInArrow(_scan, schema)


def secret_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_literal."""
    written = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    joined = lambda xs: F.array_join(F.transform(xs, written), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "literal")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("literal").alias("n_literal"),
    )

"""One parse of each source file: its chunks and the facts detectors decide on, as arrays of its row."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vulnspark.operators.arrow import pieces

FUNCTIONS, MODULE, ALL = "functions", "module", "all"
MODULE_NAME = "<module>"
UNPARSABLE, TOO_DEEP, NO_CONTENT = "unparsable", "too_deep", "no_content"

# Request-like attributes whose values an attacker controls.
REQUEST_ATTRIBUTES = {"args", "form", "GET", "POST", "json", "data", "params", "query_params"}
# Calls that read or write the file named by their first argument.
FILE_CALLS = {"open", "read_text", "read_bytes", "write_text", "write_bytes"}
# Calls that build a path from their arguments.
PATH_BUILDERS = {"os.path.join", "posixpath.join"}
# A function holding any of these words is taken to check its paths.
GUARD_WORDS = (
    "abspath", "basename", "commonpath", "commonprefix", "is_relative_to", "realpath",
    "relpath", "resolve", "safe_join", "secure_filename", "startswith",
)

PARSED = (
    "reason string, "
    "chunks array<struct<name:string,code:string,start_line:int,end_line:int,start_byte:bigint,end_byte:bigint,"
    "head:string,tail:string,is_module:boolean>>, "
    "literals array<struct<line:int,names:array<string>,value:string>>, "
    "functions array<struct<guards:array<string>,parameters:array<string>,"
    "sets:array<struct<at:int,name:string,reads:array<string>,request:boolean,builds:boolean>>,"
    "opens:array<struct<at:int,line:int,name:string,reads:array<string>>>>>"
)
#: Bytes of source text whose chunks and facts are held as Python objects at once.
PARSED_BYTES = 1 << 20
_ITEM = {
    "chunks": ("name", "code", "start_line", "end_line", "start_byte", "end_byte", "head", "tail", "is_module"),
    "literals": ("line", "names", "value"),
}

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_NOT_MODULE_CODE = (*_FUNCTION, ast.ClassDef, ast.Import, ast.ImportFrom)
_PHYSICAL_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def key_ddl(rows: DataFrame, keys: list[str]) -> str:
    """Schema text of the key columns, for Python jobs that carry them along."""
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def parse(source: str | None) -> tuple[ast.Module | None, str | None]:
    """The syntax tree, or why there is none."""
    if source is None:
        return None, NO_CONTENT
    try:
        return ast.parse(source), None
    except (SyntaxError, ValueError):
        return None, UNPARSABLE
    except (RecursionError, MemoryError):
        return None, TOO_DEEP


def _outermost_functions(tree: ast.Module) -> Iterator[ast.stmt]:
    pending = [tree]
    while pending:
        for child in ast.iter_child_nodes(pending.pop()):
            if isinstance(child, _FUNCTION):
                yield child
            else:
                pending.append(child)


def _module_runs(tree: ast.Module) -> Iterator[list[ast.stmt]]:
    for skipped, run in groupby(tree.body, lambda node: isinstance(node, _NOT_MODULE_CODE)):
        if not skipped:
            yield list(run)


def chunk_rows(tree: ast.Module, source: str, scope: str) -> list[tuple]:
    """The chunks of a file by start byte.

    `head` and `tail` are what stands before and after the chunk on its first and last
    line, so that head + code + tail is whole source lines.
    """
    raw = source.encode("utf-8", "replace")
    starts = [0, *accumulate(map(len, _PHYSICAL_LINE.findall(raw)))]
    text = lambda begin, end: raw[begin:end].decode("utf-8", "replace")

    spans = []
    if scope != MODULE:
        for fn in _outermost_functions(tree):
            begin = starts[fn.lineno - 1] + fn.col_offset
            end = starts[fn.end_lineno - 1] + fn.end_col_offset
            spans.append((begin, end, fn.name, fn.lineno, fn.end_lineno))
    if scope != FUNCTIONS:
        for run in _module_runs(tree):
            first, last = run[0].lineno, max(node.end_lineno for node in run)
            spans.append((starts[first - 1], starts[last], MODULE_NAME, first, last))
    rows = []
    for begin, end, name, first, last in sorted(spans):
        edges = text(starts[first - 1], begin), text(end, max(starts[last], end))
        rows.append((name, text(begin, end), first, last, begin, end, *edges, name == MODULE_NAME))
    return rows


def literal_rows(tree: ast.Module) -> Iterator[tuple[int, list[str], str]]:
    """(line, bound names, string) for each string literal given to a name."""
    for node in ast.walk(tree):
        match node:
            case ast.Assign(targets=targets, value=ast.Constant(value=str(text)) as literal):
                pass
            case ast.AnnAssign(target=target, value=ast.Constant(value=str(text)) as literal):
                targets = [target]
            case ast.keyword(arg=str(name), value=ast.Constant(value=str(text)) as literal):
                targets = [ast.Name(id=name)]
            case _:
                continue
        names = [getattr(t, "id", None) or getattr(t, "attr", None) for t in targets]
        yield literal.lineno, [n for n in names if isinstance(n, str)], text


def _words(node: ast.AST) -> Iterator[str]:
    """Every name and text written in a node, without comments."""
    for part in ast.walk(node):
        for _, value in ast.iter_fields(part):
            for word in value if isinstance(value, list) else (value,):
                if isinstance(word, (str, bytes)):
                    yield word if isinstance(word, str) else word.decode("latin-1")


def _dotted(node: ast.expr) -> str:
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else ""


def _names_read(node: ast.AST) -> list[str]:
    return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)})


def function_facts(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    """What a function takes, binds and opens; nothing is decided here.

    `at` is the place in the walk. An open of a plain name carries it in `name`; one of an
    expression that may hold a path carries the names it reads."""
    sets, opens = [], []
    for at, node in enumerate(ast.walk(fn)):
        match node:
            case ast.Assign(targets=[ast.Name(id=name)], value=value):
                parts = list(ast.walk(value))
                request = any(isinstance(p, ast.Attribute) and p.attr in REQUEST_ATTRIBUTES for p in parts)
                called = isinstance(value, ast.Call) and _dotted(value.func) in PATH_BUILDERS
                builds = called or isinstance(value, (ast.BinOp, ast.JoinedStr))
                sets.append({"at": at, "name": name, "reads": _names_read(value), "request": request, "builds": builds})
            case ast.Call(func=func, args=[first, *_]):
                if (getattr(func, "id", None) or getattr(func, "attr", None)) in FILE_CALLS:
                    plain = first.id if isinstance(first, ast.Name) else None
                    reads = _names_read(first) if isinstance(first, (ast.BinOp, ast.JoinedStr, ast.Call)) else []
                    opens.append({"at": at, "line": node.lineno, "name": plain, "reads": reads})
    found: set[str] = set()
    if opens:
        for word in _words(fn):
            found.update(g for g in GUARD_WORDS if g in word)
    parameters = [a.arg for a in (*fn.args.args, *fn.args.kwonlyargs) if a.arg not in ("self", "cls")]
    return {"guards": sorted(found), "parameters": parameters, "sets": sets, "opens": opens}


def facts(source: str | None, scope: str) -> dict:
    tree, reason = parse(source)
    out = {"reason": reason, "chunks": [], "literals": [], "functions": []}
    if tree is not None:
        out["chunks"] = [dict(zip(_ITEM["chunks"], row, strict=True)) for row in chunk_rows(tree, source, scope)]
        out["literals"] = [dict(zip(_ITEM["literals"], row, strict=True)) for row in literal_rows(tree)]
        functions = (function_facts(n) for n in ast.walk(tree) if isinstance(n, _FUNCTION))
        # A function that opens nothing cannot be a finding.
        out["functions"] = [f for f in functions if f["opens"]]
    return out


def parse_files(files: DataFrame, keys: list[str], scope: str = ALL) -> DataFrame:
    """One row per file of `files` (keys, content): keys, reason, chunks, literals, functions.

    A file that cannot be parsed keeps its row, with a reason and empty arrays."""
    schema = f"{key_ddl(files, keys)}, {PARSED}"
    narrow = files.select(*keys, "content")
    types = list(to_arrow_schema(T.StructType.fromDDL(PARSED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, PARSED_BYTES)):
            found = [facts(x.as_py(), scope) for x in piece.column(len(keys))]
            columns = [pa.array([f[t.name] for f in found], t.type) for t in types]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[: len(keys)], *columns], names=[*piece.schema.names[: len(keys)], *(t.name for t in types)]
            )

    return narrow.mapInArrow(run, schema)


def unparsable_files(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason) of the files that yield no chunks and no facts."""
    return parsed.filter("reason IS NOT NULL").select(*keys, "reason")

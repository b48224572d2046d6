"""SQL for DuckDB that recomputes each query from the same test tables.

Shared derivations are common table expressions; `sql(..., "name", ...)` puts those a
query needs in front of it. Window and probability arithmetic is written out again here
rather than generated from the Spark code.
"""

from __future__ import annotations

from vulnspark.functions.paths import MINING_SKIP, SKIP_DIRECTORIES
from vulnspark.functions.text import (
    LINE_WITH_BREAK,
    PLACEHOLDERS,
    SECRET_NAME,
    SECRET_VALUE,
    SPACE,
    TOKEN,
    TOKEN_ML,
)
from vulnspark.operators.calibrate import bin_edges, temperature_grid
from vulnspark.operators.source import GUARD_WORDS
from vulnspark.operators.splits import DEFAULT_SALT
from vulnspark.plans.inputs import (
    CLASS_TEXTS,
    LONG,
    MAX_TOKENS,
    RULE_IDS,
    SCORE_SCALE,
    STRIDE,
)
from vulnspark.taxonomy import CWE_LABEL, LABELS, REMEDIATION, RULE_LABEL, SEVERITY, SEVERITY_RANK

# --- expressions ---


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def mapped(mapping: dict, key: str) -> str:
    cases = " ".join(f"WHEN {text(str(k))} THEN {text(str(v))}" for k, v in mapping.items())
    return f"(CASE CAST({key} AS VARCHAR) {cases} END)"


def label(label_id: str) -> str:
    return f"({texts(LABELS)}[CAST({label_id} AS INT) + 1])"


def severity(name: str) -> str:
    return mapped(SEVERITY, name)


def rank(name: str) -> str:
    return f"CAST({mapped(SEVERITY_RANK, name)} AS INT)"


def double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def regex_all(column: str, pattern: str) -> str:
    return f"regexp_extract_all({column}, {text(pattern)})"


def entropy(column: str) -> str:
    chars = f"list_distinct(string_split({column}, ''))"
    share = f"((length({column}) - length(replace({column}, c, ''))) / length({column}))"
    return (
        f"(CASE WHEN length({column}) = 0 THEN 0.0 ELSE "
        f"-list_sum(list_transform({chars}, lambda c: {share} * log2({share}))) END)"
    )


def is_secret(name: str, value: str) -> str:
    trimmed = f"lower(regexp_replace({value}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"
    alnum = rf"length(regexp_replace({value}, '[^\p{{L}}\p{{N}}]', '', 'g')) / length({value})"
    return f"""(CASE
        WHEN list_contains({texts(PLACEHOLDERS)}, {trimmed}) OR length({value}) < 8 THEN false
        WHEN regexp_matches({value}, {text(SECRET_VALUE)}) THEN true
        WHEN NOT regexp_matches({name}, {text(SECRET_NAME)}) THEN false
        WHEN regexp_matches({value}, '[{SPACE}]') THEN false
        WHEN {alnum} < 0.8 THEN false
        ELSE length({value}) >= 16 AND {entropy(value)} >= 3.4 END)"""


def softmax(logits: str, temperature: float) -> str:
    t = double(temperature)
    shifted = f"list_transform({logits}, lambda x: exp(x / {t} - list_max({logits}) / {t}))"
    return f"list_transform({shifted}, lambda e: e / list_sum({shifted}))"


def argmax(values: str) -> str:
    return f"(list_position({values}, list_max({values})) - 1)"


def nll(temperature: float) -> str:
    t = double(temperature)
    mass = f"ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / {t}))))"
    return f"({mass} + list_max(logits) / {t} - logits[y_true + 1] / {t})"


def nll_at(t: str) -> str:
    """The same at a temperature that is a column."""
    mass = f"ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / {t}))))"
    return f"({mass} + list_max(logits) / {t} - logits[y_true + 1] / {t})"


def ratio(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} = 0 THEN 0.0 ELSE CAST({part} AS DOUBLE) / {whole} END)"


def no_break_lines(column: str) -> str:
    """Lines without breaks; the test texts break on newlines only."""
    parts = f"string_split({column}, chr(10))"
    return f"(CASE WHEN {column} LIKE '%' || chr(10) THEN {parts}[:-2] ELSE {parts} END)"


# --- shared tables ---

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (needs, body)


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in CTE[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return body
    clauses = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{clauses}\n{body}"


cte(
    "findings",
    f"""SELECT *, {severity('vulnerability_type')} AS severity FROM (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                     CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
           's' || (l_orderkey % 50) AS scan_id, 'f' || (l_partkey % 97) AS file_path,
           'fn' || l_linenumber AS function_name,
           {label('l_suppkey % 6 + 1')} AS vulnerability_type,
           l_quantity / 50 AS confidence,
           CAST(l_orderkey % 400 + 1 AS INT) AS start_line,
           (l_returnflag = 'R') AS dismissed
    FROM lineitem)""",
)
cte(
    "scans",
    """SELECT 's' || n AS id, n % 7 AS user_id, created_at, 'm' || (n % 3) AS model_version
    FROM (SELECT o_orderkey % 50 AS n, min(o_orderdate) AS created_at FROM orders GROUP BY 1)""",
)
cte(
    "pairs",
    """SELECT CAST(l_partkey % 7 AS INT) AS y_true,
           CAST(CASE WHEN l_quantity > 25 THEN l_partkey % 7 ELSE l_suppkey % 7 END AS INT) AS y_pred,
           CASE WHEN l_linestatus = 'F' THEN 'forest' ELSE 'rules' END AS approach,
           CASE WHEN l_returnflag = 'R' THEN 'test_real' ELSE 'test_full' END AS test_set
    FROM lineitem""",
)
cte(
    "logits",
    f"""SELECT *, CAST(CASE WHEN vec_id % 10 < 7 THEN {argmax('logits')} ELSE label % 7 END AS INT) AS y_true
    FROM (SELECT vec_id, label,
                 list_transform(embedding[1:7], lambda x: CAST(x AS DOUBLE) * 20) AS logits
          FROM embeddings)""",
)
cte("probs", f"SELECT *, {softmax('logits', 1.0)} AS p FROM logits", "logits")
cte(
    "scored",
    f"""SELECT list_max(p) AS confidence,
           CAST({argmax('p')} = y_true AS INT) AS correct, vec_id FROM probs""",
    "probs",
)
cte(
    "corpus",
    f"""SELECT doc_id, source AS repository_id, 'doc_' || doc_id AS file_path, text AS code,
           {label('doc_id % 7')} AS vulnerability_type,
           CASE WHEN lang = 'en' THEN 'mined' ELSE 'juliet' END AS source,
           lang <> 'en' AS is_synthetic, lang
    FROM documents""",
)
cte(
    "bucketed",
    f"""SELECT *, CAST(CAST('0x' || sha256({text(DEFAULT_SALT + ':')} || repository_id)[1:16] AS UBIGINT) AS DOUBLE)
           / 18446744073709551616.0 AS bucket FROM corpus""",
    "corpus",
)
cte(
    "split",
    """SELECT *, s = 'test_full' AND NOT is_synthetic AND source = 'mined' AS in_test_real,
           s AS split
    FROM (SELECT *, CASE WHEN bucket < 0.15 THEN 'test_full' WHEN bucket < 0.25 THEN 'validation'
                    ELSE 'train' END AS s FROM bucketed)""",
    "bucketed",
)


def windows(name: str, source: str, max_tokens: int, stride: int, *needs: str) -> None:
    """Line windows of `source`(chunk_id, code, start_line, end_line, start_byte, end_byte)."""
    cte(
        f"{name}_sized",
        f"""SELECT *, len({regex_all('code', TOKEN)}) AS n_tokens,
               {regex_all('code', LINE_WITH_BREAK)} AS lines FROM {source}""",
        *needs,
    )
    cte(
        f"{name}_plan",
        f"""SELECT *, greatest(win - least(greatest(CAST(floor({stride} / per_line) AS INT), 1), win - 1), 1) AS step
        FROM (SELECT *, greatest(CAST(floor({max_tokens - 8} / per_line) AS INT), 1) AS win
              FROM (SELECT *, n_tokens / greatest(len(lines), 1) AS per_line FROM {name}_sized
                    WHERE n_tokens > {max_tokens}))""",
        f"{name}_sized",
    )
    cte(
        f"{name}_cut",
        f"""SELECT *, least(first + win, len(lines)) AS last FROM (
            SELECT *, i * step AS first FROM (
                SELECT *, greatest(CAST(ceil((len(lines) - win) / step) AS INT), 0) + 1 AS window_count,
                       unnest(range(greatest(CAST(ceil((len(lines) - win) / step) AS INT), 0) + 1)) AS i
                FROM {name}_plan))""",
        f"{name}_plan",
    )
    cte(
        name,
        f"""SELECT chunk_id, CAST(i AS INT) AS window_index, CAST(window_count AS INT) AS window_count,
               array_to_string(lines[first + 1:last], '') AS code,
               CAST(start_line + first AS INT) AS start_line,
               CAST(start_line + last - 1 AS INT) AS end_line,
               CAST(start_byte + strlen(array_to_string(lines[1:first], '')) AS BIGINT) AS start_byte,
               CAST(start_byte + strlen(array_to_string(lines[1:last], '')) AS BIGINT) AS end_byte
        FROM {name}_cut
        UNION ALL
        SELECT chunk_id, 0, 1, code, CAST(start_line AS INT), CAST(end_line AS INT),
               CAST(start_byte AS BIGINT), CAST(end_byte AS BIGINT)
        FROM {name}_sized WHERE n_tokens <= {max_tokens}""",
        f"{name}_cut",
    )


cte(
    "whole_docs",
    f"""SELECT doc_id AS chunk_id, text AS code, 1 AS start_line, len({no_break_lines('text')}) AS end_line,
           0 AS start_byte, strlen(text) AS end_byte FROM documents""",
)
windows("short_windows", "whole_docs", MAX_TOKENS, STRIDE, "whole_docs")
windows("long_windows", "whole_docs", *LONG, "whole_docs")
for size in ("short", "long"):
    cte(
        f"{size}_chunks",
        f"""SELECT w.*, chunk_id AS doc_id, 'doc_' || chunk_id AS file_path, source AS package
        FROM {size}_windows w JOIN documents d ON d.doc_id = w.chunk_id""",
        f"{size}_windows",
    )
cte(
    "usable",
    "SELECT * FROM long_chunks WHERE end_line - start_line + 1 BETWEEN 3 AND 120",
    "long_chunks",
)
cte(
    "doc_lines",
    """SELECT doc_id, source AS package, 'doc_' || doc_id AS file_path, CAST(i AS INT) AS line,
           string_split(text, chr(10))[i] AS line_text
    FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""",
)
cte(
    "digit_hits",
    """SELECT package, file_path, line, 'COMMAND_INJECTION' AS label, line AS ord
    FROM doc_lines WHERE regexp_matches(line_text, '[0-9]')""",
    "doc_lines",
)
ASSIGN = r'([A-Za-z_][A-Za-z0-9_-]*)\s*=\s*"([^"]*)"'


def assignments(source: str, keys: str, column: str) -> str:
    found = regex_all(column, ASSIGN)
    return f"""SELECT {keys}, CAST(i - 1 AS INT) AS pos,
           regexp_extract({found}[i], {text(ASSIGN)}, 1) AS name,
           regexp_extract({found}[i], {text(ASSIGN)}, 2) AS value
    FROM (SELECT *, unnest(range(1, len({found}) + 1)) AS i FROM {source})"""


cte("sites", assignments("doc_lines", "package, file_path, line", "line_text"), "doc_lines")
cte(
    "hits",
    f"""SELECT package, file_path, line, label, 'report' AS labeler, 0 AS labeler_rank, ord FROM digit_hits
    UNION ALL
    SELECT package, file_path, line, 'HARDCODED_SECRET', 'detector', 1, pos
    FROM sites WHERE {is_secret('name', 'value')}""",
    "digit_hits",
    "sites",
)

# Token offsets: pieces are a token with the space before it, so they tile the text.
PIECE = f"[{SPACE}]*(?:{TOKEN})"
cte(
    "pieces",
    f"""SELECT chunk_id, window_index, start_line, code, i, p,
           regexp_replace(p, '^[{SPACE}]+', '') AS token,
           sum(length(p)) OVER (PARTITION BY chunk_id, window_index ORDER BY i) AS upto
    FROM (SELECT *, pieces[i] AS p FROM (
            SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM (
                SELECT *, {regex_all('code', PIECE)} AS pieces FROM short_windows)))""",
    "short_windows",
)
cte(
    "line_best",
    """SELECT chunk_id, window_index, start_line, code, line_no,
           max(((ascii(token) * 31 + length(token)) % 101) / 100.0) AS best
    FROM (SELECT *, length(code[1:upto - length(token)])
                    - length(replace(code[1:upto - length(token)], chr(10), '')) AS line_no FROM pieces)
    GROUP BY ALL""",
    "pieces",
)
cte(
    "ranked_lines",
    f"""SELECT *, row_number() OVER (PARTITION BY chunk_id, window_index ORDER BY score DESC, line) - 1 AS r
    FROM (SELECT chunk_id, window_index, start_line, CAST(start_line + line_no AS INT) AS line,
                 rtrim(({no_break_lines('code')})[line_no + 1], ' ') AS line_text,
                 CASE WHEN high > low THEN (best - low) / (high - low) ELSE 1.0 END AS score
          FROM (SELECT *, max(best) OVER w AS high, min(best) OVER w AS low FROM line_best
                WINDOW w AS (PARTITION BY chunk_id, window_index)))""",
    "line_best",
)
cte("top_lines", "SELECT * FROM ranked_lines WHERE r < 3", "ranked_lines")

# Python modules made of the documents: import, constant, blank line, one function.
QUOTED = "replace(replace(l, chr(92), chr(92) || chr(92)), '''', chr(92) || '''')"
cte(
    "modules",
    f"""SELECT doc_id, source AS scan_id, 'doc_' || doc_id || '.py' AS file_path, text, lines, n,
           (CASE WHEN doc_id % 3 = 0 THEN 'api_key' ELSE 'label' END) AS constant,
           sha256(text)[1:24] AS hex24,
           'def load_' || doc_id || '(name):' || chr(10)
             || array_to_string(list_transform(lines, lambda l: '    note = ''' || {QUOTED} || '''' || chr(10)), '')
             || (CASE WHEN doc_id % 2 = 0 THEN '    return open(''/srv/'' + name)' ELSE '    return note' END) AS body
    FROM (SELECT *, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n FROM documents)""",
)
cte(
    "module_heads",
    """SELECT *, 'import os' || chr(10) || constant || ' = "' || hex24 || '"' || chr(10) || chr(10) AS head,
           constant || ' = "' || hex24 || '"' || chr(10) AS const_line FROM modules""",
    "modules",
)
cte(
    "module_chunks",
    """SELECT scan_id, file_path, 'load_' || doc_id AS name, 4 AS start_line, CAST(n + 5 AS INT) AS end_line,
           CAST(strlen(head) AS BIGINT) AS start_byte, CAST(strlen(head) + strlen(body) AS BIGINT) AS end_byte,
           body AS code, 'function' AS scope, doc_id FROM module_heads
    UNION ALL
    SELECT scan_id, file_path, '<module>', 2, 2, 10, 10 + strlen(const_line), const_line, 'module', doc_id
    FROM module_heads""",
    "module_heads",
)
cte("scan_chunks", "SELECT *, file_path || ' ' || name AS chunk_id FROM module_chunks", "module_chunks")
windows("scan_windows", "scan_chunks", MAX_TOKENS, STRIDE, "scan_chunks")


def logit(code: str, k: int) -> str:
    found = CLASS_TEXTS[k]
    count = f"(length({code}) - length(replace({code}, {text(found)}, ''))) / {len(found)}"
    return f"({count} / greatest(length({code}), 1) * {SCORE_SCALE})"


LOGITS = "[" + ", ".join(f"CAST({logit('code', k)} AS DOUBLE)" for k in range(len(LABELS))) + "]"
cte(
    "scan_best",
    f"""SELECT chunk_id, arg_max(struct_pack(p := p, w := window_index),
                             struct_pack(mass := list_sum(p[2:7]), early := -window_index)) AS best
    FROM (SELECT chunk_id, window_index, {softmax('l', 0.5)} AS p
          FROM (SELECT chunk_id, window_index, {LOGITS} AS l FROM scan_windows))
    GROUP BY 1""",
    "scan_windows",
)
cte(
    "scan_found",
    f"""SELECT c.*, {label('k')} AS label, conf, p, w FROM (
        SELECT chunk_id, best.p AS p, best.w AS w, {argmax('best.p')} AS k, list_max(best.p) AS conf FROM scan_best)
    JOIN scan_chunks c USING (chunk_id) WHERE k > 0 AND conf >= 0.5""",
    "scan_best",
)
cte(
    "scan_pieces",
    f"""SELECT chunk_id, start_line, code, regexp_replace(p, '^[{SPACE}]+', '') AS token,
           sum(length(p)) OVER (PARTITION BY chunk_id ORDER BY i) AS upto
    FROM (SELECT *, pieces[i] AS p FROM (
            SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM (
                SELECT chunk_id, w.start_line, w.code, {regex_all('w.code', PIECE)} AS pieces
                FROM scan_windows w JOIN scan_found f USING (chunk_id) WHERE w.window_index = f.w)))""",
    "scan_found",
    "scan_windows",
)
cte(
    "scan_line_scores",
    """SELECT chunk_id, CAST(start_line + line_no AS INT) AS line, max(s) AS s FROM (
        SELECT *, ((ascii(token) * 31 + length(token)) % 101) / 100.0 AS s,
               length(code[1:upto - length(token)])
                 - length(replace(code[1:upto - length(token)], chr(10), '')) AS line_no
        FROM scan_pieces) GROUP BY ALL""",
    "scan_pieces",
)
cte(
    "scan_anchor",
    """SELECT chunk_id, arg_max(line, struct_pack(s := s, early := -line)) AS anchor_line,
           CAST(least(count(*), 3) AS INT) AS n_lines FROM scan_line_scores GROUP BY 1""",
    "scan_line_scores",
)
SNIPPET = """(CASE WHEN len(ls) > 40
    THEN array_to_string(ls[1:40], chr(10)) || chr(10) || '... (' || (len(ls) - 40) || ' more lines)'
    ELSE array_to_string(ls, chr(10)) END)"""
cte(
    "scan_result",
    f"""SELECT scan_id, file_path, name AS function_name, label AS vulnerability_type,
           {severity('label')} AS severity, round(conf, 6) AS confidence, true AS confidence_calibrated,
           CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line,
           coalesce(anchor_line, start_line) AS anchor_line, coalesce(n_lines, 0) AS n_lines,
           p[1] AS p_safe, md5({SNIPPET}) AS snippet_digest
    FROM (SELECT *, {no_break_lines('code')} AS ls FROM scan_found LEFT JOIN scan_anchor USING (chunk_id))""",
    "scan_found",
    "scan_anchor",
)

# Archives made of the pages.
cte(
    "page_files",
    r"""SELECT page_id, page_id % 20 AS g, n,
           (CASE page_id % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'Tests/'
            WHEN 3 THEN 'a-b/' ELSE 'a/' END) || tail || '_' || page_id AS stem,
           CASE page_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.pyi' ELSE '.py' END AS suffix
    FROM (SELECT page_id, strlen(html) AS n,
                 regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS tail
          FROM pages)""",
)
cte(
    "members",
    """SELECT 'a' || g AS archive,
           CASE WHEN g = 8 THEN NULL WHEN g = 5 THEN 'tar' ELSE 'zip' END AS format,
           CAST(CASE WHEN g = 9 THEN 62914560 ELSE 1000 END AS BIGINT) AS upload_bytes,
           CAST(page_id AS INT) AS member_index,
           CASE WHEN g = 1 AND page_id % 40 = 21 THEN '../' || stem || suffix
                WHEN g = 2 AND page_id % 40 = 2 THEN '/' || stem || suffix
                WHEN g = 3 AND page_id % 100 = 3 THEN 'C:/' || stem || suffix
                WHEN g = 7 THEN stem || '.md' ELSE stem || suffix END AS name,
           CASE WHEN g = 4 AND page_id % 40 = 24 THEN 'link'
                WHEN g = 5 AND page_id % 100 = 25 THEN 'other' ELSE 'file' END AS kind,
           CAST(CASE WHEN g = 6 THEN n * 200 ELSE n END AS BIGINT) AS size,
           CAST(CASE WHEN g = 6 THEN 1 ELSE n // (1 + page_id % 40) END AS BIGINT) AS compressed
    FROM page_files""",
    "page_files",
)
PARTS = r"list_filter(string_split(replace(name, '\', '/'), '/'), lambda x: x <> '' AND x <> '.')"
SAFE_PATH = rf"(name <> '' AND NOT regexp_matches(name, '^[/\\]') AND name[2:2] <> ':' AND NOT list_contains({PARTS}, '..'))"
SKIPPED = f"list_has_any({PARTS}, {texts(SKIP_DIRECTORIES)})"
PYTHON = r"regexp_matches(name, '(^|/)[^/]+\.pyi?$')"
cte(
    "judged",
    f"""SELECT *, CASE WHEN NOT {SAFE_PATH} THEN 'unsafe_path' WHEN kind = 'link' THEN 'link'
                  WHEN format = 'tar' AND kind = 'other' THEN 'unsupported_member' END AS fault,
           kind = 'file' AND {PYTHON} AND NOT {SKIPPED} AND size <= 2097152 AS is_source
    FROM members""",
    "members",
)
cte(
    "verdicts",
    """SELECT archive, format, upload_bytes, members, uncompressed, compressed, python_files, python_bytes,
           CASE WHEN upload_bytes > 52428800 THEN 'upload_too_large'
                WHEN format IS NULL THEN 'unsupported_format'
                WHEN members > 20000 THEN 'too_many_members'
                WHEN fault IS NOT NULL THEN fault
                WHEN uncompressed > 524288000 THEN 'too_large'
                WHEN format = 'zip' AND compressed > 0 AND uncompressed / compressed > 100 THEN 'compression_ratio'
                WHEN python_bytes > 524288000 THEN 'selection_too_large'
                WHEN python_files = 0 THEN 'no_python_files' END AS reason
    FROM (SELECT archive, max(format) AS format, max(upload_bytes) AS upload_bytes, count(*) AS members,
                 CAST(sum(size) AS BIGINT) AS uncompressed, CAST(sum(compressed) AS BIGINT) AS compressed,
                 count(*) FILTER (WHERE is_source) AS python_files,
                 CAST(coalesce(sum(size) FILTER (WHERE is_source), 0) AS BIGINT) AS python_bytes,
                 arg_min(fault, member_index) FILTER (WHERE fault IS NOT NULL) AS fault
          FROM judged GROUP BY archive)""",
    "judged",
)

# --- metrics from pairs, for any grouping columns ---

N = len(LABELS)


def metrics_sql(by: tuple[str, ...], per_class: bool) -> str:
    on = f"({', '.join(by)})" if by else "(one)"
    keys = ", ".join(by) if by else "1 AS one"
    names = ", ".join(by) if by else "one"
    extra = ""
    if per_class:
        for name in LABELS:
            for field in ("recall", "f1", "support"):
                extra += (
                    f", {'round(' if field != 'support' else ''}max(CASE WHEN label = {text(name)} THEN {field} END)"
                    f"{', 6)' if field != 'support' else ''} AS {field}_{name}"
                )
    out = f"{names}, " if by else ""
    return f"""WITH p AS ({CTE['pairs'][1]}),
    cells AS (SELECT {keys}, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
    groups AS (SELECT DISTINCT {names} FROM cells),
    grid AS (SELECT {names}, k, {texts(LABELS)}[k + 1] AS label FROM groups, range({N}) r(k)),
    raw AS (SELECT g.*,
        coalesce((SELECT sum(n) FROM cells c WHERE {_same(names, 'c', 'g')} AND y_true = k AND y_pred = k), 0) AS tp,
        coalesce((SELECT sum(n) FROM cells c WHERE {_same(names, 'c', 'g')} AND y_true = k), 0) AS support,
        coalesce((SELECT sum(n) FROM cells c WHERE {_same(names, 'c', 'g')} AND y_pred = k), 0) AS guessed
        FROM grid g),
    pr AS (SELECT *, {ratio('tp', 'guessed')} AS precision, {ratio('tp', 'support')} AS recall FROM raw),
    scores AS (SELECT *, {ratio('2 * precision * recall', '(precision + recall)')} AS f1 FROM pr),
    totals AS (SELECT {names}, sum(n) AS n, sum(n) FILTER (WHERE y_true = y_pred) AS right_n,
        sum(n) FILTER (WHERE y_true = 0) AS safe, sum(n) FILTER (WHERE y_true = 0 AND y_pred > 0) AS false_alarms,
        sum(n) FILTER (WHERE y_true > 0) AS vuln, sum(n) FILTER (WHERE y_true > 0 AND y_pred > 0) AS caught
        FROM cells GROUP BY {names})
    SELECT {out}CAST(any_value(t.n) AS BIGINT) AS n,
        round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1,
        round(coalesce(avg(f1) FILTER (WHERE support >= 20), 0), 6) AS macro_f1_supported,
        CAST(count(*) FILTER (WHERE support >= 20) AS INT) AS n_classes_supported,
        round(avg(precision) FILTER (WHERE support > 0), 6) AS macro_precision,
        round(avg(recall) FILTER (WHERE support > 0), 6) AS macro_recall,
        round(any_value(right_n / t.n), 6) AS accuracy,
        round(any_value(false_alarms / safe), 6) AS false_positive_rate,
        round(any_value(caught / vuln), 6) AS vulnerable_detection_rate{extra.replace('support END)', 'CAST(support AS BIGINT) END)')}
    FROM scores JOIN totals t USING {on} {'GROUP BY ' + names if by else ''}"""


def _same(names: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{n.strip()} = {b}.{n.strip()}" for n in names.split(","))


ORACLES: dict[str, str] = {}

# --- sources ---

ORACLES["corpus_roundtrip"] = sql(
    f"""SELECT repository_id, file_path, sha256(code) AS code_digest, vulnerability_type, 1 AS start_line,
       CAST(len({no_break_lines('code')}) AS INT) AS end_line, source, is_synthetic,
       CASE WHEN doc_id % 7 > 0 THEN 1 ELSE 0 END AS n_lines, lang FROM corpus""",
    "corpus",
)
ORACLES["corpus_invariants"] = sql(
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing_repository'
       WHEN doc_id % 11 = 0 THEN 'synthetic_flag_contradicts_source'
       WHEN doc_id % 17 = 0 THEN 'unknown_label' END AS violation FROM documents"""
)
cte(
    "cwe_rows",
    """SELECT event_id, 'src/' || event_type || '.py' AS path, CAST(user_id + 1 AS INT) AS line,
       unnest([CAST(json_extract(props, '$.k') AS INT)]
              || CASE WHEN event_id % 3 = 0 THEN [CAST(user_id % 600 AS INT)] ELSE [] END) AS cwe,
       unnest(CASE WHEN event_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS ord FROM events""",
)
ORACLES["cwe_hits"] = sql(
    f"""SELECT * FROM (SELECT event_id, path, line, CAST(ord AS INT) AS ord, 'CWE-' || cwe AS cwe_id,
       {mapped(CWE_LABEL, "'CWE-' || cwe")} AS label FROM cwe_rows) WHERE label IS NOT NULL""",
    "cwe_rows",
)
ORACLES["rule_baseline_pred"] = f"""WITH f AS (
    SELECT user_id AS record_id, event_id,
           {mapped(RULE_LABEL, f"{texts(RULE_IDS)}[CAST(json_extract(props, '$.k') AS INT) % {len(RULE_IDS)} + 1]")} AS label
    FROM events),
b AS (SELECT record_id, arg_min(label, event_id) AS label FROM f WHERE label IS NOT NULL GROUP BY 1)
SELECT c_custkey AS record_id, CAST(coalesce(list_position({texts(LABELS)}, label) - 1, 0) AS INT) AS y_pred
FROM customer LEFT JOIN b ON record_id = c_custkey"""
ORACLES["top_sources"] = """SELECT source AS name, count(*) AS n FROM documents GROUP BY 1
ORDER BY n DESC, name LIMIT 10"""
ORACLES["archive_members"] = """SELECT 'page_' || page_id || '.zip' AS archive, 'zip' AS format, 0 AS member_index,
       'src/page_' || page_id || '.py' AS name, 'file' AS kind, CAST(strlen(html) AS BIGINT) AS size FROM pages
UNION ALL SELECT 'page_' || page_id || '.zip', 'zip', 1, 'README.md', 'file', strlen('page ' || page_id) FROM pages"""
ORACLES["archive_sources"] = """SELECT 'page_' || page_id || '.zip' AS archive,
       'src/page_' || page_id || '.py' AS file_path, sha256(html) AS digest FROM pages
-- a page that packs over 100 to 1 is refused; none of the test pages does"""
ORACLES["skipped_files"] = """WITH p AS (SELECT page_id % 5 AS k, 'page_' || page_id AS name FROM pages)
SELECT name || '.zip' AS archive, 'src/' || name || '.py' AS file_path,
       CASE k WHEN 1 THEN 'unparsable' ELSE 'not_utf8' END AS reason FROM p WHERE k IN (1, 2)
UNION ALL SELECT name || '.zip', NULL, CASE k WHEN 3 THEN 'unreadable' ELSE 'no_python_files' END FROM p WHERE k IN (3, 4)
UNION ALL SELECT name || '.zip', 'node_modules/' || name || '.py', 'skipped_folder' FROM p WHERE k < 3"""
ORACLES["archive_verdict"] = sql("SELECT * FROM verdicts", "verdicts")
ORACLES["source_select"] = sql(
    f"""SELECT archive, name, size, member_index,
       CAST(sum(size) OVER (PARTITION BY archive ORDER BY {PARTS}, member_index) AS BIGINT) AS running_bytes
    FROM judged WHERE is_source AND archive IN (SELECT archive FROM verdicts WHERE reason IS NULL)""",
    "judged",
    "verdicts",
)
ORACLES["mining_select"] = sql(
    f"""SELECT archive, name, size FROM members WHERE name LIKE '%.py' AND {SAFE_PATH}
       AND NOT list_has_any(list_transform({PARTS}, lambda x: lower(x)), {texts(MINING_SKIP)})""",
    "members",
)
ORACLES["calibration_lookup"] = sql(
    """SELECT s.id, s.model_version, coalesce(t, 1.0) AS temperature, coalesce(t, 1.0) <> 1.0 AS calibrated
    FROM scans s LEFT JOIN (SELECT 'm' || (s_suppkey % 3) AS m, round(avg(abs(s_acctbal)) / 4000, 4) AS t
                            FROM supplier GROUP BY 1) ON m = s.model_version AND m <> 'm2'""",
    "scans",
)

# --- scalar functions ---

ORACLES["fingerprint"] = "SELECT doc_id, sha256(text)[1:16] AS fingerprint FROM documents"
for name, pattern in (("tokens", TOKEN), ("tokens_ml", TOKEN_ML)):
    ORACLES[name] = f"""SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS digest
    FROM (SELECT doc_id, {regex_all('text', pattern)} AS t FROM documents)"""
SHINGLES = """(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda j: array_to_string(t[j:j + 4], ' '))) END)"""
cte("shingled", f"SELECT *, {SHINGLES} AS s FROM (SELECT doc_id, lang, {regex_all('text', TOKEN)} AS t FROM documents)")
ORACLES["shingles"] = sql(
    "SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(list_sort(s), '|')) AS digest FROM shingled",
    "shingled",
)
ORACLES["repo_bucket"] = f"""SELECT doc_id, round(CAST(CAST('0x' ||
    sha256({text(DEFAULT_SALT + ':')} || source || '/' || doc_id)[1:16] AS UBIGINT) AS DOUBLE)
    / 18446744073709551616.0, 9) AS bucket FROM documents"""
ORACLES["severity_map"] = sql(
    f"SELECT doc_id, vulnerability_type, {severity('vulnerability_type')} AS severity FROM corpus", "corpus"
)
ORACLES["char_entropy"] = f"SELECT doc_id, round({entropy('text')}, 6) AS entropy FROM documents"
ORACLES["secret_literals"] = f"""SELECT doc_id, pos, name, value, {is_secret('name', 'value')} AS is_secret
FROM ({assignments('documents', 'doc_id', 'text')})"""
ORACLES["safe_paths"] = sql(
    f"SELECT member_index, name, {SAFE_PATH} AS safe, {SKIPPED} AS skipped, {PYTHON} AS python FROM members",
    "members",
)
ORACLES["offset_to_line"] = """SELECT doc_id, "offset", CAST(10 + len(list_filter(
    list_transform(range(1, len(ls)), lambda i: strlen(array_to_string(ls[1:i], chr(10))) + 1),
    lambda e: e <= "offset")) AS INT) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls,
             CAST(floor(strlen(text) * (doc_id % 5) / 4 - doc_id % 3) AS BIGINT) AS "offset" FROM documents)"""
ORACLES["snippets"] = f"""SELECT doc_id, md5(cut) AS digest, CAST(len(string_split(cut, chr(10))) AS INT) AS n_lines
FROM (SELECT doc_id, CASE WHEN last - first + 1 > 40
        THEN array_to_string(ls[first:first + 39], chr(10)) || chr(10) || '... (' || (last - first - 39) || ' more lines)'
        ELSE array_to_string(ls[first:last], chr(10)) END AS cut
      FROM (SELECT doc_id, ls, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS first, greatest(len(ls), 2) AS last
            FROM (SELECT doc_id, {no_break_lines('text')} AS ls FROM documents)))"""
ORACLES["argmax_pred"] = sql(f"SELECT vec_id, CAST({argmax('logits')} AS INT) AS y_pred FROM logits", "logits")
ORACLES["softmax_probs"] = sql(
    "SELECT vec_id, " + ", ".join(f"round(p[{i + 1}], 6) AS p{i}" for i in range(N))
    + f" FROM (SELECT vec_id, {softmax('logits', 1.5)} AS p FROM logits)",
    "logits",
)
ORACLES["one_hot"] = sql(
    "SELECT y_pred, " + ", ".join(f"count(*) FILTER (WHERE y_pred = {i}) AS hot{i}" for i in range(N))
    + " FROM pairs GROUP BY 1",
    "pairs",
)
ORACLES["prob_map"] = sql(
    f"SELECT vec_id, {texts(LABELS)}[i] AS label, round(p[i], 4) AS probability FROM probs, range(1, {N + 1}) r(i)",
    "probs",
)

# --- chunks ---

CHUNK_COLUMNS = """scan_id, file_path, name, start_line, end_line, start_byte, end_byte,
    sha256(code) AS code_digest, scope"""
ORACLES["chunk_all"] = sql(f"SELECT {CHUNK_COLUMNS} FROM module_chunks", "module_chunks")
ORACLES["chunk_functions"] = sql(
    f"SELECT {CHUNK_COLUMNS} FROM module_chunks WHERE scope = 'function'", "module_chunks"
)
ORACLES["chunk_module"] = sql(
    f"SELECT {CHUNK_COLUMNS} FROM module_chunks WHERE scope = 'module'", "module_chunks"
)
ORACLES["chunk_udtf"] = sql(
    "SELECT scan_id, file_path, name, start_line, end_line FROM module_chunks", "module_chunks"
)
ORACLES["line_windows"] = sql(
    """SELECT chunk_id AS doc_id, window_index, window_count, start_line, end_line, start_byte, end_byte,
       sha256(code) AS code_digest FROM short_windows""",
    "short_windows",
)
GUARDED = f"regexp_matches(text, {text('|'.join(GUARD_WORDS))})"
cte(
    "label_sites",
    f"""SELECT file_path, 2 AS line, 'HARDCODED_SECRET' AS label FROM modules WHERE {is_secret('constant', 'hex24')}
    UNION ALL
    SELECT file_path, CAST(4 + i AS INT), 'HARDCODED_SECRET' FROM (
        SELECT file_path, i, lines[i] AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM modules))
    WHERE {is_secret("'note'", 'v')}
    UNION ALL
    SELECT file_path, CAST(n + 5 AS INT), 'PATH_TRAVERSAL' FROM modules WHERE doc_id % 2 = 0 AND NOT {GUARDED}""",
    "modules",
)
ORACLES["label_files"] = sql(
    "SELECT file_path, CAST(line AS INT) AS line, label FROM label_sites", "label_sites"
)
ORACLES["label_udtf"] = ORACLES["label_files"]
ORACLES["snippet_heat"] = sql(
    f"""SELECT id, CAST(c.line AS INT) AS line, md5(c.line_text) AS text_digest, round(score, 6) AS score
    FROM (SELECT 'doc_' || chunk_id || ':' || window_index AS id, chunk_id, window_index, start_line + i - 1 AS line,
                 CASE WHEN i = 41 THEN '... (' || (len(ls) - 40) || ' more lines)' ELSE ls[i] END AS line_text
          FROM (SELECT *, unnest(range(1, least(len(ls), 41) + 1)) AS i
                FROM (SELECT *, {no_break_lines('code')} AS ls FROM short_windows))) c
    LEFT JOIN top_lines t ON t.chunk_id = c.chunk_id AND t.window_index = c.window_index AND t.line = c.line""",
    "short_windows",
    "top_lines",
)

# --- hits and labels ---

ORACLES["all_hits"] = sql(
    "SELECT package, file_path, line, label, labeler, labeler_rank, CAST(ord AS INT) AS ord FROM hits", "hits"
)
ORACLES["hits_in_chunks"] = sql(
    """SELECT c.package, c.file_path, window_index, h.line, h.label FROM short_chunks c JOIN digit_hits h
    ON c.package = h.package AND c.file_path = h.file_path AND h.line BETWEEN start_line AND end_line""",
    "short_chunks",
    "digit_hits",
)
ORACLES["hits_in_chunks_sweep"] = ORACLES["hits_in_chunks"]
ORACLES["label_chunks"] = sql(
    """SELECT c.file_path, start_byte,
       arg_min(label, struct_pack(line := line, r := labeler_rank, o := ord)) AS label,
       arg_min(labeler, struct_pack(line := line, r := labeler_rank, o := ord)) AS labeler, min(line) AS line
    FROM usable c JOIN hits h ON c.package = h.package AND c.file_path = h.file_path
         AND line BETWEEN start_line AND end_line GROUP BY c.package, c.file_path, start_byte""",
    "usable",
    "hits",
)
ORACLES["safe_sample"] = sql(
    """SELECT package, file_path, start_byte, start_line, end_line FROM (
        SELECT *, row_number() OVER (PARTITION BY package ORDER BY file_path, start_byte) AS r FROM usable c
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.package = c.package AND h.file_path = c.file_path))
    WHERE r <= 12""",
    "usable",
    "hits",
)
ORACLES["mined_records"] = sql(
    """, fn AS (SELECT *, 4 AS s, n + 5 AS e FROM modules WHERE n + 2 BETWEEN 3 AND 120),
    marks AS (SELECT file_path, line, label, 1 AS rank, 0 AS ord FROM label_sites
        UNION ALL SELECT file_path, unnest([2, 5]), 'SQL_INJECTION', 0, unnest([2, 5]) FROM modules WHERE doc_id % 7 = 0),
    vuln AS (SELECT fn.file_path, arg_min(struct_pack(line := line, label := label, rank := rank),
                                          struct_pack(line := line, rank := rank, ord := ord)) AS b
        FROM fn JOIN marks m ON m.file_path = fn.file_path AND line BETWEEN s AND e GROUP BY 1),
    safe AS (SELECT * FROM (SELECT fn.*, row_number() OVER (PARTITION BY scan_id ORDER BY file_path) AS r FROM fn
        WHERE file_path NOT IN (SELECT file_path FROM marks)) WHERE r <= 12)
    SELECT 'pypi/' || scan_id AS repository_id, file_path, b.label AS vulnerability_type, 4 AS start_line,
        CAST(e AS INT) AS end_line, CAST(b.line AS VARCHAR) AS lines,
        CASE b.rank WHEN 0 THEN 'report' ELSE 'detector' END AS labeler, 'load_' || doc_id AS function
    FROM fn JOIN vuln USING (file_path)
    UNION ALL SELECT 'pypi/' || scan_id, file_path, 'SAFE', 4, CAST(e AS INT), '', 'none', 'load_' || doc_id FROM safe""",
    "label_sites",
).replace(")\n, fn AS", "),\nfn AS")

# --- splits and statistics ---

ORACLES["corpus_union"] = sql("SELECT doc_id, repository_id, source, is_synthetic FROM corpus", "corpus")
ORACLES["splits"] = sql("SELECT doc_id, repository_id, split, in_test_real FROM split", "split")
ORACLES["split_leakage"] = sql(
    """SELECT a || '-' || b AS pair, (SELECT count(*) FROM (
        SELECT repository_id FROM split WHERE split = a INTERSECT SELECT repository_id FROM split WHERE split = b)) AS shared_repositories
    FROM (VALUES ('train', 'validation'), ('train', 'test_full'), ('validation', 'test_full')) v(a, b)""",
    "split",
)
ORACLES["split_summary"] = sql(
    "SELECT set_name, count(*) AS n, count(*) FILTER (WHERE is_synthetic) AS n_synthetic, "
    + ", ".join(f"count(*) FILTER (WHERE vulnerability_type = {text(x)}) AS n_{x}" for x in LABELS)
    + """ FROM (SELECT *, split AS set_name FROM split UNION ALL SELECT *, 'test_real' FROM split WHERE in_test_real)
    GROUP BY 1""",
    "split",
)


def stats_sql(source: str) -> str:
    return f"""SELECT 'total' AS metric, '' AS key, count(*) AS n FROM {source}
    UNION ALL SELECT 'synthetic', '', count(*) FILTER (WHERE is_synthetic) FROM {source}
    UNION ALL SELECT 'real', '', count(*) FILTER (WHERE NOT is_synthetic) FROM {source}
    UNION ALL SELECT 'repositories', '', count(DISTINCT repository_id) FROM {source}
    UNION ALL SELECT 'by_label', vulnerability_type, count(*) FROM {source} GROUP BY 2
    UNION ALL SELECT 'by_label_real_only', vulnerability_type, count(*) FILTER (WHERE NOT is_synthetic) FROM {source} GROUP BY 2
    UNION ALL SELECT 'by_source', source, count(*) FROM {source} GROUP BY 2
    UNION ALL SELECT 'splits', split, count(*) FROM {source} GROUP BY 2
    UNION ALL SELECT 'splits', 'test_real', count(*) FILTER (WHERE in_test_real) FROM {source}"""


ORACLES["corpus_stats"] = sql(stats_sql("split"), "split")
ORACLES["repository_sketches"] = sql(
    "SELECT split, count(DISTINCT file_path) AS exact, true AS within_bound FROM split GROUP BY 1", "split"
)
ORACLES["class_weights"] = sql(
    f""", c AS (SELECT k AS label_id, {texts(LABELS)}[k + 1] AS label,
        (SELECT count(*) FROM corpus
            WHERE CASE doc_id % 7 WHEN 2 THEN 'SAFE' ELSE vulnerability_type END = {texts(LABELS)}[k + 1]) AS n
        FROM range({N}) r(k)),
    w AS (SELECT *, CASE WHEN n > 0 THEN (SELECT sum(n) FROM c) / ({N} * n) ELSE 0.0 END AS raw FROM c)
    SELECT CAST(label_id AS INT) AS label_id, label, n,
        round(raw / (SELECT avg(raw) FROM w WHERE raw > 0), 6) AS weight FROM w""",
    "corpus",
).replace(")\n, c AS", "),\nc AS")
ORACLES["labeled_docs"] = sql(
    """SELECT vulnerability_type, count(*) AS n, count(quality) AS n_labeled,
       CAST(coalesce(sum(quality), 0) AS BIGINT) AS n_good
    FROM corpus LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "corpus",
)
ORACLES["fit_pool"] = sql(
    """SELECT doc_id, is_synthetic FROM split WHERE split = 'validation' AND (NOT is_synthetic OR
       (SELECT count(*) FROM split WHERE split = 'validation' AND NOT is_synthetic) < 50)""",
    "split",
)
ORACLES["synthetic_share"] = sql(
    """SELECT split, count(*) AS n, round(avg(is_synthetic::INT), 6) AS synthetic_share,
       avg(is_synthetic::INT) > 0.4 AS warn FROM split GROUP BY 1""",
    "split",
)

# --- evaluation ---

ORACLES["confusion"] = sql(
    f"""SELECT CAST(t AS INT) AS y_true, CAST(p AS INT) AS y_pred,
       (SELECT count(*) FROM pairs WHERE y_true = t AND y_pred = p) AS n FROM range({N}) a(t), range({N}) b(p)""",
    "pairs",
)
ORACLES["confusion_pivot"] = sql(
    f"SELECT {label('t')} AS true_label, "
    + ", ".join(
        f"(SELECT count(*) FROM pairs WHERE y_true = t AND y_pred = {p}) AS pred_{x}" for p, x in enumerate(LABELS)
    )
    + f" FROM range({N}) a(t)",
    "pairs",
)
ORACLES["per_class"] = sql(
    f"""SELECT CAST(k AS INT) AS label_id, {label('k')} AS label, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round({ratio('2 * precision * recall', '(precision + recall)')}, 6) AS f1, support
    FROM (SELECT k, {ratio('tp', 'guessed')} AS precision, {ratio('tp', 'support')} AS recall, support
          FROM (SELECT k, (SELECT count(*) FROM pairs WHERE y_true = k AND y_pred = k) AS tp,
                       (SELECT count(*) FROM pairs WHERE y_true = k) AS support,
                       (SELECT count(*) FROM pairs WHERE y_pred = k) AS guessed FROM range({N}) r(k)))""",
    "pairs",
)
ORACLES["metrics"] = metrics_sql((), True)
ORACLES["benchmark_table"] = metrics_sql(("approach", "test_set"), False)
ORACLES["report_sink"] = ORACLES["benchmark_table"]
EDGES = "[" + ", ".join(double(e) for e in bin_edges()) + "]"
cte("binned", f"SELECT *, len(list_filter({EDGES}[1:15], lambda e: confidence > e)) AS bin FROM scored", "scored")
ORACLES["ece"] = sql(
    """SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN bin > 0 THEN n * gap ELSE 0 END) / sum(n), 6) AS ece
    FROM (SELECT bin, count(*) AS n, abs(avg(correct) - avg(confidence)) AS gap FROM binned GROUP BY 1)""",
    "binned",
)
ORACLES["reliability"] = sql(
    f"""SELECT CAST(i AS INT) AS bin, round({EDGES}[i], 6) AS bin_lower, round({EDGES}[i + 1], 6) AS bin_upper,
       count(vec_id) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(correct), 6) AS accuracy
    FROM range(1, 16) r(i) LEFT JOIN binned ON bin = i GROUP BY i""",
    "binned",
)
ORACLES["fit_temperature"] = sql(
    "SELECT round(t, 6) AS temperature, round(before, 6) AS nll_before, round(loss, 6) AS nll_after, n FROM ("
    + " UNION ALL ".join(
        f"SELECT {double(t)} AS t, avg({nll(t)}) AS loss, avg({nll(1.0)}) AS before, count(*) AS n FROM logits"
        for t in temperature_grid()
    )
    + ") ORDER BY loss, t LIMIT 1",
    "logits",
)

# The slope of the loss has one zero; halving finds it without any derivative of its own.
ORACLES["fit_temperature_newton"] = sql(
    f""", halved(step, low, high) AS (
        SELECT 0, -8.0::DOUBLE, 8.0::DOUBLE
        UNION ALL
        SELECT step + 1, CASE WHEN slope < 0 THEN mid ELSE low END, CASE WHEN slope < 0 THEN high ELSE mid END FROM (
            SELECT step, low, high, mid, avg(s[y_true + 1] - list_sum(list_transform(list_zip(w, s), lambda z: z[1] * z[2]))
                / list_sum(w)) AS slope
            FROM (SELECT *, list_transform(s, lambda x: exp(x - list_max(s))) AS w FROM (
                SELECT step, low, high, (low + high) / 2 AS mid, y_true,
                       list_transform(logits, lambda x: x / exp((low + high) / 2)) AS s
                FROM halved, logits WHERE step < 50))
            GROUP BY step, low, high, mid)
    ), found AS (SELECT exp((low + high) / 2) AS t FROM halved WHERE step = 50)
    SELECT round(any_value(t), 6) AS temperature, round(avg({nll(1.0)}), 6) AS nll_before,
           round(avg({nll_at('t')}), 6) AS nll_after, count(*) AS n, true AS flat
    FROM logits, found""",
    "logits",
    recursive=True,
)


def ece_by_set(temperature: float, name: str) -> str:
    return f"""SELECT set_name, sum(CASE WHEN bin > 0 THEN n * gap ELSE 0 END) / sum(n) AS {name} FROM (
        SELECT set_name, bin, count(*) AS n, abs(avg(correct) - avg(conf)) AS gap FROM (
            SELECT *, len(list_filter({EDGES}[1:15], lambda e: conf > e)) AS bin FROM (
                SELECT set_name, list_max(p) AS conf, CAST({argmax('p')} = y_true AS INT) AS correct
                FROM (SELECT *, {softmax('logits', temperature)} AS p FROM sets))) GROUP BY 1, 2) GROUP BY 1"""


cte(
    "sets",
    "SELECT *, 'test_full' AS set_name FROM logits UNION ALL SELECT *, 'test_real' FROM logits WHERE vec_id % 3 = 0",
    "logits",
)
ORACLES["calibration_transfer"] = sql(
    f"""SELECT set_name, n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence,
       round(ece_before, 6) AS ece_before, round(ece_after, 6) AS ece_after,
       mean_confidence - accuracy > 0.1 AS overconfident
    FROM (SELECT set_name, count(*) AS n, avg(CAST({argmax('logits')} = y_true AS INT)) AS accuracy,
                 avg(list_max({softmax('logits', 1.65)})) AS mean_confidence FROM sets GROUP BY 1)
    JOIN ({ece_by_set(1.0, 'ece_before')}) USING (set_name) JOIN ({ece_by_set(1.65, 'ece_after')}) USING (set_name)""",
    "sets",
)

# --- localization ---

ORACLES["line_attribution"] = sql(
    """SELECT chunk_id AS doc_id, window_index, CAST(r AS INT) AS rank, line, round(score, 6) AS score,
       md5(line_text) AS text_digest FROM top_lines""",
    "top_lines",
)
ORACLES["anchor_line"] = sql(
    """SELECT w.chunk_id AS doc_id, w.window_index, coalesce(t.line, w.start_line) AS anchor_line
    FROM short_windows w LEFT JOIN (SELECT * FROM top_lines WHERE r = 0) t
    ON t.chunk_id = w.chunk_id AND t.window_index = w.window_index""",
    "short_windows",
    "top_lines",
)
cte(
    "localized",
    """SELECT w.chunk_id, w.window_index, w.chunk_id % 7 AS y_true,
       CASE WHEN w.chunk_id % 4 = 0 THEN 0 ELSE w.chunk_id % 7 END AS y_pred,
       EXISTS (SELECT 1 FROM digit_hits h WHERE h.file_path = w.file_path AND h.line BETWEEN w.start_line AND w.end_line) AS has_truth,
       coalesce((SELECT bool_or(h.line IS NOT NULL) FROM top_lines t JOIN digit_hits h ON h.line = t.line AND h.file_path = w.file_path
         WHERE t.chunk_id = w.chunk_id AND t.window_index = w.window_index AND r < 1), false) AS hit1,
       coalesce((SELECT bool_or(h.line IS NOT NULL) FROM top_lines t JOIN digit_hits h ON h.line = t.line AND h.file_path = w.file_path
         WHERE t.chunk_id = w.chunk_id AND t.window_index = w.window_index AND r < 3), false) AS hit3
    FROM short_chunks w""",
    "short_chunks",
    "top_lines",
    "digit_hits",
)
ORACLES["localization_topk"] = sql(
    """SELECT count(*) AS n, round(avg(hit1::INT), 6) AS top_1_line_accuracy,
       round(avg(hit3::INT), 6) AS top_3_line_accuracy FROM localized""",
    "localized",
)
ORACLES["localization_report"] = sql(
    """SELECT count(*) AS n, round(avg(hit1::INT), 6) AS top_1_line_accuracy,
       round(avg(hit3::INT), 6) AS top_3_line_accuracy,
       round(avg((y_pred = y_true)::INT), 6) AS class_accuracy_on_these
    FROM localized WHERE has_truth AND y_true > 0""",
    "localized",
)
ORACLES["eval_sample"] = sql(
    """SELECT doc_id, vulnerability_type FROM corpus WHERE doc_id % 7 > 0
    ORDER BY sha256('42:' || doc_id), doc_id LIMIT 400""",
    "corpus",
)

# --- reports ---

ORACLES["summary_by_severity"] = sql(
    f"""SELECT scan_id, severity, count(*) AS count, any_value({rank('severity')}) AS rank
    FROM findings WHERE NOT dismissed GROUP BY 1, 2""",
    "findings",
)
ORACLES["summary_by_type"] = sql(
    "SELECT scan_id, vulnerability_type, count(*) AS count FROM findings WHERE NOT dismissed GROUP BY 1, 2",
    "findings",
)
WORST = mapped({v: k for k, v in SEVERITY_RANK.items()}, f"max({rank('severity')})")
ORACLES["summary_by_file"] = sql(
    f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY count DESC, file_path) AS INT) AS rank
    FROM (SELECT scan_id, file_path, count(*) AS count, {WORST} AS highest_severity
          FROM findings WHERE NOT dismissed GROUP BY 1, 2)) WHERE rank <= 50""",
    "findings",
)
cte("every_scan", "SELECT DISTINCT 's' || (o_orderkey % 60) AS scan_id FROM orders")
ORACLES["summary_totals"] = sql(
    """SELECT e.scan_id, count(f.id) AS total_findings, round(avg(confidence), 6) AS mean_confidence
    FROM every_scan e LEFT JOIN findings f ON f.scan_id = e.scan_id AND NOT dismissed GROUP BY 1""",
    "findings",
    "every_scan",
)
ORACLES["dashboard_summary"] = sql(
    " UNION ALL ".join(
        f"""SELECT scan_id, '{section}' AS section, {key} AS key, count(*) AS count,
        round(avg(confidence), 6) AS mean_confidence, {WORST} AS highest_severity
        FROM findings WHERE NOT dismissed GROUP BY scan_id, {key}
        QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY count(*) DESC, {key}) <= 50"""
        for section, key in (
            ("total", "''"), ("severity", "severity"), ("type", "vulnerability_type"), ("file", "file_path"),
        )
    )
    + """ UNION ALL SELECT scan_id, 'total', '', 0, NULL, NULL FROM every_scan
        WHERE scan_id NOT IN (SELECT scan_id FROM findings WHERE NOT dismissed)""",
    "findings",
    "every_scan",
)
ORACLES["list_findings"] = sql(
    """SELECT f.id, scan_id, file_path, severity, vulnerability_type, confidence
    FROM findings f JOIN scans s ON s.id = f.scan_id
    WHERE scan_id = 's10' AND user_id = 3 AND NOT dismissed AND severity = 'HIGH'
    ORDER BY confidence DESC, f.id LIMIT 100 OFFSET 5""",
    "findings",
    "scans",
)
ORACLES["owned_findings"] = sql(
    "SELECT f.id, scan_id, vulnerability_type FROM findings f JOIN scans s ON s.id = f.scan_id WHERE user_id = 3",
    "findings",
    "scans",
)
ORACLES["list_scans"] = sql(
    """SELECT id, user_id, CAST(created_at AS VARCHAR) AS created_at FROM scans WHERE user_id = 3
    ORDER BY scans.created_at DESC, id LIMIT 20 OFFSET 1""",
    "scans",
)
ORACLES["owned_finding"] = sql(
    """SELECT CAST(user_id AS INT) AS user_id, f.id, scan_id, severity FROM findings f JOIN scans s ON s.id = f.scan_id
    WHERE f.id = (SELECT min(id) FROM findings) AND user_id BETWEEN 0 AND 6""",
    "findings",
    "scans",
)
TITLES = {name: advice[0] for name, advice in REMEDIATION.items()}
ORACLES["with_remediation"] = sql(
    f"""SELECT v AS vulnerability_type, {mapped(TITLES, 'v')} AS title, count(*) AS n
    FROM (SELECT CASE WHEN start_line % 13 = 0 THEN 'RETIRED' ELSE vulnerability_type END AS v FROM findings) GROUP BY 1, 2""",
    "findings",
)
ORACLES["taxonomy"] = sql(
    f"""SELECT CAST(k AS INT) AS label_id, {label('k')} AS label, {severity(label('k'))} AS severity, k > 0 AS has_remediation,
       (SELECT count(*) FROM findings WHERE vulnerability_type = {label('k')}) AS n_findings FROM range({N}) r(k)""",
    "findings",
)
ORACLES["scan_counters"] = sql(
    """SELECT scan_id, coalesce(n, 0) AS files_scanned, coalesce(c, 0) AS functions_scanned,
       coalesce(f, 0) AS findings_count
    FROM every_scan
    LEFT JOIN (SELECT 's' || (o_orderkey % 50) AS scan_id, count(*) AS n FROM orders GROUP BY 1) USING (scan_id)
    LEFT JOIN (SELECT 's' || (l_orderkey % 60) AS scan_id, count(*) AS c FROM lineitem GROUP BY 1) USING (scan_id)
    LEFT JOIN (SELECT scan_id, count(*) AS f FROM findings GROUP BY 1) USING (scan_id)""",
    "findings",
    "every_scan",
)
ORACLES["apply_dismissals"] = """WITH d AS (SELECT user_id, arg_max(props, struct_pack(ts := ts, e := event_id)) AS reason
    FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT c_custkey AS id, 's' || c_nationkey AS scan_id, c_acctbal < 0 OR reason IS NOT NULL AS dismissed,
       coalesce(reason, CASE WHEN c_acctbal < 0 THEN 'older' END) AS dismissed_reason
FROM customer LEFT JOIN d ON user_id = c_custkey"""
ORACLES["retention"] = sql(
    "SELECT id, scan_id FROM findings WHERE scan_id NOT IN (SELECT 's' || (n_nationkey * 2) FROM nation)",
    "findings",
)
ORACLES["retention_rewrite"] = ORACLES["retention"]
ORACLES["scan_deletion"] = sql(
    """SELECT s.id AS scan_id, count(f.id) AS n_findings FROM scans s JOIN findings f ON f.scan_id = s.id
    WHERE s.id NOT IN (SELECT 's' || (n_nationkey * 2) FROM nation) GROUP BY 1""",
    "scans",
    "findings",
)
ORACLES["apply_dismissals_bucketed"] = ORACLES["apply_dismissals"]
ORACLES["deep_findings_page"] = sql(
    """SELECT row_number() OVER (ORDER BY confidence DESC, id) - 1 AS place, id, scan_id, confidence
    FROM findings WHERE scan_id = 's10' AND NOT dismissed ORDER BY place LIMIT 100 OFFSET 40""",
    "findings",
)
ORACLES["deep_scans_page"] = sql(
    """SELECT row_number() OVER (ORDER BY created_at DESC, id) - 1 AS place, id, user_id
    FROM scans WHERE user_id = 3 ORDER BY place LIMIT 4 OFFSET 2""",
    "scans",
)
ORACLES["duplicate_keys"] = sql(
    """SELECT scan_id, file_path, function_name, start_line, count(*) AS n FROM findings
    GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""",
    "findings",
)

# --- scoring and scans ---

cte(
    "vector_rows",
    f"""SELECT *, {argmax('p')} AS k, list_max(p) AS conf, 's' || (vec_id % 5) AS scan_id, 'f' || (vec_id % 40) AS file_path,
       'fn' || (vec_id % 2) AS function_name, CAST(label % 3 AS INT) AS start_line FROM probs""",
    "probs",
)
ORACLES["emit_findings"] = sql(
    f"""SELECT vec_id, scan_id, file_path, function_name, start_line, {label('k')} AS label,
       {severity(label('k'))} AS severity, round(conf, 6) AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, file_path, function_name, start_line ORDER BY vec_id) AS r
          FROM vector_rows WHERE k > 0 AND conf >= 0.5) WHERE r = 1""",
    "vector_rows",
)
ORACLES["merge_windows"] = sql(
    f"""SELECT parent, window_index, {label('k')} AS label, round(conf, 6) AS confidence, round(mass, 6) AS vulnerable_mass
    FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY mass DESC, window_index) AS r
          FROM (SELECT *, vec_id // 4 AS parent, CAST(vec_id % 4 AS INT) AS window_index, list_sum(p[2:7]) AS mass
                FROM vector_rows)) WHERE r = 1""",
    "vector_rows",
)
ORACLES["score_chunks"] = sql(
    "SELECT chunk_id AS doc_id, window_index, "
    + ", ".join(f"round({logit('code', k)}, 6) AS logit{k}" for k in range(N))
    + " FROM short_windows",
    "short_windows",
)
ORACLES["scan_findings"] = sql(
    "SELECT * REPLACE (round(p_safe, 6) AS p_safe) FROM scan_result", "scan_result"
)
ORACLES["stream_scan"] = ORACLES["scan_findings"]
ORACLES["findings_sink"] = sql(
    "SELECT * REPLACE (round(p_safe, 4) AS p_safe) FROM scan_result", "scan_result"
)

# --- near duplicates: SHA-1 mode, 16 hashes in 4 bands ---

cte(
    "signatures",
    """SELECT doc_id, lang, i, coalesce(v, '0000000000000000') AS v FROM (
        SELECT doc_id, lang, i, list_min(list_transform(s, lambda x: sha1(from_hex(lpad(hex(i), 2, '0') || '000000') || encode(x))[1:16])
            .list_transform(lambda h: h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])) AS v
        FROM (SELECT *, unnest(range(16)) AS i FROM shingled))""",
    "shingled",
)
ORACLES["minhash_sig"] = sql("SELECT doc_id, CAST(i AS INT) AS i, v AS value FROM signatures", "signatures")
cte(
    "signed",
    """SELECT doc_id, lang <> 'en' AS synth, list(v ORDER BY i) AS sig,
       row_number() OVER (ORDER BY lang <> 'en', doc_id) AS idx FROM signatures GROUP BY doc_id, lang""",
    "signatures",
)
cte(
    "banded",
    "SELECT idx, doc_id, sig, b, array_to_string(sig[b * 4 + 1:b * 4 + 4], ',') AS bkey FROM signed, range(4) r(b)",
    "signed",
)
SIMILARITY = "len(list_filter(list_zip({a}, {b}), lambda z: z[1] = z[2])) / 16"
cte(
    "close_pairs",
    f"""SELECT *, row_number() OVER (ORDER BY a, b) AS rn FROM (
        SELECT DISTINCT x.idx AS a, y.idx AS b, x.doc_id AS da, y.doc_id AS db FROM banded x JOIN banded y
        ON x.b = y.b AND x.bkey = y.bkey AND x.idx < y.idx
        WHERE {SIMILARITY.format(a='x.sig', b='y.sig')} >= 0.85)""",
    "banded",
)
ORACLES["lsh_pairs"] = sql(
    f"""SELECT DISTINCT f.doc_id AS a, m.doc_id AS b, round({SIMILARITY.format(a='f.sig', b='m.sig')}, 6) AS similarity
    FROM banded m JOIN (SELECT b, bkey, min(idx) AS first FROM banded GROUP BY 1, 2) l USING (b, bkey)
    JOIN signed f ON f.idx = l.first WHERE m.idx > l.first""",
    "banded",
)
# Visits similar pairs in order; a pair drops its later record unless either is gone.
cte(
    "greedy",
    """SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS gone, CAST([] AS BIGINT[]) AS keepers
    UNION ALL
    SELECT g.step + 1,
       CASE WHEN list_contains(gone, da) OR list_contains(gone, db) THEN gone ELSE list_append(gone, db) END,
       CASE WHEN list_contains(gone, da) OR list_contains(gone, db) THEN keepers ELSE list_append(keepers, da) END
    FROM greedy g JOIN close_pairs p ON p.rn = g.step + 1""",
    "close_pairs",
)
cte(
    "dropped",
    """SELECT unnest(gone) AS dropped, unnest(keepers) AS kept FROM (SELECT * FROM greedy ORDER BY step DESC LIMIT 1)""",
    "greedy",
)
ORACLES["near_dup_pairs"] = sql("SELECT dropped, kept FROM dropped", "dropped", recursive=True)
ORACLES["dedup_kept"] = sql(
    "SELECT doc_id, lang <> 'en' AS is_synthetic FROM documents WHERE doc_id NOT IN (SELECT dropped FROM dropped)",
    "dropped",
    recursive=True,
)
cte("kept_split", "SELECT * FROM split WHERE doc_id NOT IN (SELECT dropped FROM dropped)", "split", "dropped")
ORACLES["corpus_build"] = sql(
    stats_sql("kept_split") + " UNION ALL SELECT 'duplicates_dropped', '', count(*) FROM dropped",
    "kept_split",
    recursive=True,
)

# --- streams ---

ORACLES["stream_dedup"] = sql(
    "SELECT DISTINCT scan_id, file_path, function_name, start_line FROM findings", "findings"
)
ORACLES["stream_first_of_scan"] = ORACLES["stream_dedup"]
ORACLES["stream_summary"] = ORACLES["summary_by_severity"]

# --- classifier ---

cte(
    "training",
    f"""SELECT s.doc_id, s.doc_id % 7 AS y, {regex_all('d.text', TOKEN_ML)} AS t
    FROM split s JOIN documents d USING (doc_id) WHERE split = 'train'""",
    "split",
)
cte(
    "term_rows",
    """SELECT doc_id, y, term, count(*) AS n FROM (SELECT doc_id, y, unnest(t
        || list_transform(range(1, len(t)), lambda j: t[j] || ' ' || t[j + 1])
        || list_transform(range(1, len(t) - 1), lambda j: t[j] || ' ' || t[j + 1] || ' ' || t[j + 2])) AS term
        FROM training) GROUP BY ALL""",
    "training",
)
cte(
    "frequent_terms",
    f"""SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df,
       {', '.join(f'count(*) FILTER (WHERE y = {c}) AS c{c}' for c in range(N))}
    FROM term_rows GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 50000""",
    "term_rows",
)
cte(
    "class_sizes",
    f"SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE y = {c}) AS s{c}' for c in range(N))} FROM training",
    "training",
)


def class_cell(c: int) -> str:
    expected = f"(df * (s{c} / n))"
    return (
        f"CASE WHEN s{c} > 0 THEN pow(c{c} - {expected}, 2) * (1 / {expected} + 1 / ((n - df) * (s{c} / n))) ELSE 0.0 END"
    )


cte(
    "chosen_terms",
    f"""SELECT term, tf, df, CASE WHEN df < n THEN round({' + '.join(map(class_cell, range(N)))}, 6) ELSE 0.0 END AS chi2
    FROM frequent_terms, class_sizes ORDER BY chi2 DESC, term LIMIT 2000""",
    "frequent_terms",
    "class_sizes",
)
ORACLES["chosen_terms"] = sql("SELECT * FROM chosen_terms", "chosen_terms")
ORACLES["tfidf_weights"] = sql(
    """SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
    FROM (SELECT r.doc_id, term, r.n * ln((s.n + 1) / (df + 1)) AS w
          FROM term_rows r JOIN chosen_terms USING (term), class_sizes s) WHERE w <> 0""",
    "term_rows",
    "chosen_terms",
    "class_sizes",
)

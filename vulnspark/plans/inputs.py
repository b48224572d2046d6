"""The engine's logical tables, derived by Spark from the star-schema test tables.

Each function takes (spark, sf_dir) and returns one table; `oracles.py` holds the same
derivations in SQL.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.functions.probability import argmax
from vulnspark.functions.text import SPACE, TOKEN, let, prefix_sums, split_lines
from vulnspark.operators.chunks import line_windows
from vulnspark.session import spread
from vulnspark.taxonomy import label_name, severity_for

MAX_TOKENS, STRIDE = 64, 16
# Long windows, for labeling chunks of several lines.
LONG = (512, 128)

RULE_IDS = (
    "B101", "B105", "B108", "B110", "B301", "B311", "B403", "B506", "B602", "B605",
    "B608", "B610", "B701",
)

# The test scorer counts these texts, one per class.
CLASS_TEXTS = ("note", "th", "is", "on", "er", "en", "the")
SCORE_SCALE = 60.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit_concat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- findings and scans ---


def findings_from(lineitem: DataFrame) -> DataFrame:
    key = F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    )
    label = label_name(F.col("l_suppkey") % 6 + 1)
    start = (F.col("l_orderkey") % 400 + 1).cast("int")
    return lineitem.select(
        key.alias("id"),
        lit_concat("s", F.col("l_orderkey") % 50).alias("scan_id"),
        lit_concat("f", F.col("l_partkey") % 97).alias("file_path"),
        lit_concat("fn", F.col("l_linenumber")).alias("function_name"),
        label.alias("vulnerability_type"),
        severity_for(label).alias("severity"),
        (F.col("l_quantity") / 50).alias("confidence"),
        start.alias("start_line"),
        (start + F.col("l_linenumber")).alias("end_line"),
        (F.col("l_returnflag") == "R").alias("dismissed"),
        F.lit(None).cast("string").alias("dismissed_reason"),
        F.col("l_shipdate").alias("created_at"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_from(table(spark, sf_dir, "lineitem"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("number", F.col("o_orderkey") % 50)
    return (
        orders.groupBy("number")
        .agg(F.min("o_orderdate").alias("created_at"))
        .select(
            lit_concat("s", F.col("number")).alias("id"),
            (F.col("number") % 7).alias("user_id"),
            "created_at",
            lit_concat("m", F.col("number") % 3).alias("model_version"),
        )
    )


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted temperatures of models m0, m1 and m9; m2 was never calibrated, m9 made no scan."""
    group = F.col("s_suppkey") % 3
    model = lit_concat("m", F.when(group == 2, F.lit(9)).otherwise(group)).alias("model_version")
    return table(spark, sf_dir, "supplier").groupBy(model).agg(
        F.round(F.avg(F.abs("s_acctbal")) / 4000, 4).alias("temperature")
    )


def dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dismissals by event; an event names its finding by user id and a number in its props."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return events.select(
        F.col("user_id").alias("finding_id"),
        F.col("props").alias("reason"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


def customer_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per customer, the target of `dismissals`."""
    customer = table(spark, sf_dir, "customer")
    return customer.select(
        F.col("c_custkey").alias("id"),
        lit_concat("s", F.col("c_nationkey")).alias("scan_id"),
        (F.col("c_acctbal") < 0).alias("dismissed"),
        F.when(F.col("c_acctbal") < 0, "older").alias("dismissed_reason"),
    )


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(lit_concat("s", F.col("n_nationkey") * 2).alias("scan_id"))


# --- predictions ---


def labeled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    truth = (F.col("l_partkey") % 7).cast("int")
    guess = F.when(F.col("l_quantity") > 25, truth).otherwise((F.col("l_suppkey") % 7).cast("int"))
    return lineitem.select(
        truth.alias("y_true"),
        guess.alias("y_pred"),
        F.when(F.col("l_linestatus") == "F", "forest").otherwise("rules").alias("approach"),
        F.when(F.col("l_returnflag") == "R", "test_real").otherwise("test_full").alias("test_set"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    vector = F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double") * 20)
    mixed = F.when(F.col("vec_id") % 10 < 7, argmax(F.col("logits"))).otherwise(F.col("label") % 7)
    return embeddings.select("vec_id", "label", vector.alias("logits")).withColumn("y_true", mixed)


# --- corpus ---


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def corpus_from(docs: DataFrame) -> DataFrame:
    n_lines = F.size(split_lines(F.col("text")))
    return docs.select(
        F.col("source").alias("repository_id"),
        lit_concat("doc_", F.col("doc_id")).alias("file_path"),
        F.lit("python").alias("language"),
        F.col("text").alias("code"),
        label_name(F.col("doc_id") % 7).alias("vulnerability_type"),
        F.lit(1).alias("start_line"),
        n_lines.alias("end_line"),
        F.when(F.col("lang") == "en", "mined").otherwise("juliet").alias("source"),
        (F.col("lang") != "en").alias("is_synthetic"),
        F.when(F.col("doc_id") % 7 > 0, F.array(F.lit(1)))
        .otherwise(F.array().cast("array<int>"))
        .alias("vulnerable_lines"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        "doc_id",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from(documents(spark, sf_dir))


def corpus_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without its text, for reports that never read it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit("").alias("text"))
    return corpus_from(docs).drop("code", "end_line")


def every_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of sixty scans, of which the last ten have no findings."""
    return table(spark, sf_dir, "orders").select(lit_concat("s", F.col("o_orderkey") % 60).alias("id")).distinct()


# --- chunks, hits, token scores ---


def document_chunks(
    spark: SparkSession, sf_dir: str, max_tokens: int = MAX_TOKENS, stride: int = STRIDE
) -> DataFrame:
    """Line windows of each document; a document is a file of the package `source`."""
    whole = documents(spark, sf_dir).select(
        F.col("source").alias("package"),
        lit_concat("doc_", F.col("doc_id")).alias("file_path"),
        F.col("text").alias("code"),
        F.lit(1).alias("start_line"),
        F.size(split_lines(F.col("text"))).alias("end_line"),
        F.lit(0).cast("bigint").alias("start_byte"),
        F.octet_length("text").cast("bigint").alias("end_byte"),
        "doc_id",
    )
    return line_windows(whole, max_tokens=max_tokens, stride_tokens=stride)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("source").alias("package"),
        lit_concat("doc_", F.col("doc_id")).alias("file_path"),
        F.posexplode_outer(F.split("text", "\n")).alias("pos", "line_text"),
    ).withColumn("line", F.col("pos") + 1)


def digit_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report hits: one per line holding a digit."""
    lines = document_lines(spark, sf_dir).filter(F.col("line_text").rlike("[0-9]"))
    return lines.select(
        "package", "file_path", "line", F.lit("COMMAND_INJECTION").alias("label"), F.col("line").alias("ord")
    )


def with_token_scores(chunks: DataFrame) -> DataFrame:
    """Adds token_scores: per token its character offset and a score made from its text."""
    piece = F.lit(f"[{SPACE}]*({TOKEN})")
    lengths = F.transform(F.regexp_extract_all(F.col("code"), piece, F.lit(0)), F.length)

    def entry(token: Column, end: Column) -> Column:
        return F.struct(
            (end - F.length(token)).alias("start"),
            ((F.ascii(token) * 31 + F.length(token)) % 101 / 100).alias("score"),
        )

    scores = F.zip_with(F.regexp_extract_all(F.col("code"), piece, F.lit(1)), prefix_sums(lengths), entry)
    return chunks.withColumn("token_scores", scores)


# --- Python modules written from the documents ---


def modules_from(docs: DataFrame) -> DataFrame:
    """A parsable source file per document: one constant, one function holding its lines."""
    quoted = F.transform(
        F.split("text", "\n"),
        lambda line: F.concat(
            F.lit("    note = '"),
            F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")),
            F.lit("'\n"),
        ),
    )
    odd = F.lit("    return note\n")
    ending = F.when(F.col("doc_id") % 2 == 0, F.lit("    return open('/srv/' + name)\n")).otherwise(odd)
    constant = F.when(F.col("doc_id") % 3 == 0, "api_key").otherwise("label")
    content = F.concat(
        F.lit("import os\n"),
        constant,
        F.lit(' = "'),
        F.substring(F.sha2("text", 256), 1, 24),
        F.lit('"\n\ndef load_'),
        F.col("doc_id").cast("string"),
        F.lit("(name):\n"),
        F.array_join(quoted, ""),
        ending,
    )
    return docs.select(
        F.col("source").alias("scan_id"),
        lit_concat("doc_", F.col("doc_id"), ".py").alias("file_path"),
        content.alias("content"),
    )


def python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules_from(documents(spark, sf_dir))


def load_text_scorer():
    """Seven logits per text: how often each class text occurs, relative to length."""

    def score(texts: list[str]) -> np.ndarray:
        counts = np.array([[t.count(c) for c in CLASS_TEXTS] for t in texts], dtype=float)
        lengths = np.array([max(len(t), 1) for t in texts], dtype=float)
        return counts / lengths[:, None] * SCORE_SCALE

    return score


# --- archives and reports ---


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty archives of page files; the first ten are refused, each for another reason."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").alias("n"))
    page, group = F.col("page_id"), F.col("page_id") % 20
    tail = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*/?", ""), r"[?#].*$", "")
    folder = (
        F.when(page % 7 == 0, "src/")
        .when(page % 7 == 1, "node_modules/")
        .when(page % 7 == 2, "Tests/")
        .when(page % 7 == 3, "a-b/")
        .otherwise("a/")
    )
    suffix = F.when(page % 5 == 0, ".txt").when(page % 5 == 1, ".pyi").otherwise(".py")
    plain = F.concat(folder, tail, lit_concat("_", page), suffix)
    name = (
        F.when((group == 1) & (page % 40 == 21), lit_concat("../", plain))
        .when((group == 2) & (page % 40 == 2), lit_concat("/", plain))
        .when((group == 3) & (page % 100 == 3), lit_concat("C:/", plain))
        .when(group == 7, F.concat(folder, tail, lit_concat("_", page), F.lit(".md")))
        .otherwise(plain)
    )
    kind = (
        F.when((group == 4) & (page % 40 == 24), "link")
        .when((group == 5) & (page % 100 == 25), "other")
        .otherwise("file")
    )
    size = F.when(group == 6, F.col("n") * 200).otherwise(F.col("n")).cast("bigint")
    compressed = F.when(group == 6, F.lit(1).cast("bigint")).otherwise(
        F.floor(F.col("n") / (1 + page % 40)).cast("bigint")
    )
    return pages.select(
        lit_concat("a", group).alias("archive"),
        F.when(group == 8, None).when(group == 5, "tar").otherwise("zip").alias("format"),
        F.when(group == 9, 60 * 1024 * 1024).otherwise(1000).cast("bigint").alias("upload_bytes"),
        page.cast("int").alias("member_index"),
        name.alias("name"),
        kind.alias("kind"),
        size.alias("size"),
        compressed.alias("compressed"),
    )


#: Archives written at once.
ZIPPED = 100


def _zip_pages(members: Callable[[int, str], dict[str, str | bytes]], damaged: Callable[[int], bool] = lambda page: False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole[at : at + ZIPPED] for whole in batches for at in range(0, len(whole), ZIPPED)):
            blobs = []
            for page, html in zip(batch.page_id, batch.html):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    for name, data in members(page, html).items():
                        archive.writestr(name, data)
                blob = bytearray(buffer.getvalue())
                if damaged(page):  # another checksum in the first entry of the directory
                    blob[blob.index(b"PK\x01\x02") + 16] ^= 0xFF
                blobs.append(bytes(blob))
            yield pd.DataFrame(
                {
                    "archive": [f"page_{p}.zip" for p in batch.page_id],
                    "upload_bytes": [len(b) for b in blobs],
                    "content": blobs,
                }
            )

    return run


def zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zip per page, in the shape of the binary file source."""
    members = lambda page, html: {f"src/page_{page}.py": html, "README.md": f"page {page}"}
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.mapInPandas(_zip_pages(members), "archive string, upload_bytes bigint, content binary")


def mixed_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zip per page whose source, by page_id % 5, is a comment, no Python, not UTF-8, damaged,
    or not there; each also has a copy in a folder that is skipped."""

    def members(page: int, html: str) -> dict[str, str | bytes]:
        case = page % 5
        text = "# " + re.sub(r"[^\w ]", " ", html) + "\n" if case == 0 else f"<{html}" if case == 1 else "x = 1\n"
        source = b"# \xff\xfe\n" if case == 2 else text
        own = {} if case == 4 else {f"src/page_{page}.py": source}
        return {**own, f"node_modules/page_{page}.py": "x = 1\n"}

    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.mapInPandas(
        _zip_pages(members, lambda page: page % 5 == 3), "archive string, upload_bytes bigint, content binary"
    )


def cwe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, path, line, cwe); some findings name two CWEs."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    second = F.when(F.col("event_id") % 3 == 0, lit_concat('", "CWE-', F.col("user_id") % 600)).otherwise("")
    return events.select(
        "event_id",
        lit_concat("src/", F.col("event_type"), ".py").alias("path"),
        (F.col("user_id") + 1).cast("int").alias("line"),
        F.concat(lit_concat('["CWE-', k, ": weakness"), second, F.lit('"]')).alias("cwe"),
    )


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("record_id"),
        F.get(F.lit(list(RULE_IDS)), k % len(RULE_IDS)).alias("test_id"),
        F.col("event_id").alias("pos"),
    )


def rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"))



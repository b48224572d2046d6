"""Batch scoring and the scan job: files to findings."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.functions.probability import argmax, class_map, softmax, vulnerable_mass
from vulnspark.functions.text import let, snippet
from vulnspark.operators.arrow import VECTOR, append_column, list_array
from vulnspark.operators.chunks import with_windows
from vulnspark.operators.dashboard import first_per_location
from vulnspark.operators.localize import anchor_line, attribute_lines
from vulnspark.schemas import LINE_SCORES
from vulnspark.taxonomy import NUM_LABELS, label_name, severity_for

MIN_CONFIDENCE = 0.5
BATCH = 16


class Scorer(Protocol):
    """Text batch in, one row of seven logits per text out."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def _append_logits(
    df: DataFrame, name: str, data_type, texts_of, shape, load: Callable[[], Scorer], batch_size: int
) -> DataFrame:
    """Scores the texts `texts_of(batch)` in model batches; `shape` lays the vectors out."""

    def start():
        scorer = load()

        def step(batch: pa.RecordBatch) -> pa.Array:
            texts = texts_of(batch)
            parts = [scorer(texts[i : i + batch_size]) for i in range(0, len(texts), batch_size)]
            flat = np.concatenate(parts).astype(np.float64) if parts else np.empty((0, NUM_LABELS))
            vectors = list_array(np.full(len(texts), NUM_LABELS), pa.array(flat.ravel()))
            return shape(batch, vectors)

        return step

    return append_column(df, name, data_type, start)


def score_chunks(
    chunks: DataFrame, load: Callable[[], Scorer], batch_size: int = BATCH, text: str = "code"
) -> DataFrame:
    """Adds `logits`. `load` runs once per task, not once per batch or row."""
    texts_of = lambda batch: [t or "" for t in batch.column(text).to_pylist()]
    return _append_logits(
        chunks, "logits", VECTOR, texts_of, lambda batch, vectors: vectors, load, batch_size
    )


def score_windows(chunks: DataFrame, load: Callable[[], Scorer], batch_size: int = BATCH) -> DataFrame:
    """Adds `window_logits`, one vector per entry of `windows`."""

    def texts_of(batch: pa.RecordBatch) -> list[str]:
        return batch.column("windows").flatten().field("code").to_pylist()

    def shape(batch: pa.RecordBatch, vectors: pa.Array) -> pa.Array:
        sizes = np.diff(batch.column("windows").offsets.to_numpy())
        return list_array(sizes, vectors)

    nested = T.ArrayType(VECTOR)
    return _append_logits(chunks, "window_logits", nested, texts_of, shape, load, batch_size)


def _window_rank(probs: Column, index: Column) -> Column:
    """Greatest for the most vulnerable window, and the earliest of equal ones."""
    return F.struct(
        vulnerable_mass(probs).alias("mass"), (-index).alias("early"), probs.alias("probs")
    )


def merge_windows(scored: DataFrame, parent: list[str]) -> DataFrame:
    """The window of each parent with most vulnerable mass, the earliest on ties.

    For windows stored as rows (parent key, window_index, probs): one maximum over structs,
    combined in each task before the shuffle.
    """
    best = _window_rank(F.col("probs"), F.col("window_index"))
    merged = scored.groupBy(*parent).agg(F.max(best).alias("best"))
    return merged.select(
        *parent,
        F.col("best.mass").alias("vulnerable_mass"),
        (-F.col("best.early")).alias("window_index"),
        "best.probs",
    )


def merge_window_array(chunks: DataFrame, temperature: Column | float) -> DataFrame:
    """The same choice for windows still held in their chunk's row: nothing is shuffled."""
    ranked = F.transform(
        "window_logits",
        lambda logits, i: let(softmax(logits, temperature), lambda p: _window_rank(p, i)),
    )
    best = chunks.withColumn("_best", F.array_max(ranked))
    return best.withColumns(
        {"probs": F.col("_best.probs"), "window": F.get("windows", -F.col("_best.early"))}
    ).drop("_best", "windows", "window_logits")


def with_prediction(rows: DataFrame) -> DataFrame:
    """label, severity and confidence of each row's `probs`."""
    top = let(
        F.col("probs"),
        lambda p: F.struct(argmax(p).alias("id"), F.array_max(p).alias("confidence")),
    )
    named = rows.withColumn("_top", top).withColumns(
        {"label": label_name(F.col("_top.id")), "confidence": F.col("_top.confidence")}
    )
    return named.withColumn("severity", severity_for(F.col("label"))).drop("_top")


def reportable(predictions: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return predictions.filter(
        (F.col("label") != "SAFE") & (F.col("confidence") >= min_confidence)
    )


def emit_findings(
    predictions: DataFrame, order: list[str], min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Confident vulnerable predictions, the first one of each location."""
    return first_per_location(reportable(predictions, min_confidence), order)


def predict_chunks(
    chunks: DataFrame, load: Callable[[], Scorer], temperature: float = 1.0, **windows
) -> DataFrame:
    """One prediction per chunk. From windows to merged result each chunk stays one row."""
    scored = score_windows(with_windows(chunks, **windows), load)
    return with_prediction(merge_window_array(scored, temperature))


def scan_findings(
    chunks: DataFrame,
    load: Callable[[], Scorer],
    temperature: float = 1.0,
    min_confidence: float = MIN_CONFIDENCE,
    token_scores: Callable[[DataFrame], DataFrame] | None = None,
    **windows,
) -> DataFrame:
    """Findings of every scan, from the chunks of its files.

    `token_scores` adds that column, given `code` and `start_line` of the chosen window. It
    runs on reported chunks only. The one shuffle is by finding location, after filtering.
    """
    predicted = predict_chunks(chunks, load, temperature, **windows)
    found = emit_findings(
        predicted.withColumnRenamed("name", "function_name"), ["start_byte", "end_byte"], min_confidence
    )
    if token_scores:
        own = found.withColumns({"_code": F.col("code"), "_line": F.col("start_line")})
        window = {"code": F.col("window.code"), "start_line": F.col("window.start_line")}
        scored = attribute_lines(token_scores(own.withColumns(window)))
        found = scored.withColumns({"code": F.col("_code"), "start_line": F.col("_line")})
    else:
        found = found.withColumn("contributing_lines", F.array().cast(LINE_SCORES))
    located = F.concat_ws(":", "scan_id", "file_path", "function_name", "start_line")
    source_lines = F.concat("head", "code", "tail")
    n_lines = F.col("end_line") - F.col("start_line") + 1
    return found.select(
        F.substring(F.sha2(located, 256), 1, 36).alias("id"),
        "scan_id",
        "file_path",
        "function_name",
        F.col("label").alias("vulnerability_type"),
        "severity",
        "confidence",
        F.lit(temperature != 1.0).alias("confidence_calibrated"),
        "start_line",
        "end_line",
        anchor_line(F.col("contributing_lines"), F.col("start_line")).alias("anchor_line"),
        "contributing_lines",
        class_map(F.col("probs")).alias("probabilities"),
        snippet(source_lines, F.lit(1), n_lines).alias("code_snippet"),
        F.lit(False).alias("dismissed"),
        F.lit(None).cast("string").alias("dismissed_reason"),
        F.current_timestamp().alias("created_at"),
    )

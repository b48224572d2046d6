"""Confusion matrices and the metrics derived from them, for any number of groups at once.

Predictions carry `y_true` and `y_pred` class ids plus the grouping columns (`by`).
They are counted once per (group, true, predicted) cell; everything after works on the
at most 49 cells of a group.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnspark.taxonomy import LABELS, NUM_LABELS

CLASSES = range(NUM_LABELS)


def _matrices(predictions: DataFrame, by: list[str]) -> DataFrame:
    """One row per group with its confusion counts as an array `cm`, row-major."""
    cells = predictions.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    # At most 49 entries a group, so collecting them is bounded.
    known = F.col("y_true").between(0, NUM_LABELS - 1) & F.col("y_pred").between(0, NUM_LABELS - 1)
    unknown = F.raise_error(F.concat_ws(" ", F.lit("no such class id:"), "y_true", "y_pred")).cast("int")
    at = F.when(known, F.col("y_true") * NUM_LABELS + F.col("y_pred")).otherwise(unknown)
    entry = F.struct(at.cast("int").alias("at"), "n")
    counts = F.map_from_entries(F.collect_list(entry))
    dense = F.transform(
        F.lit(list(range(NUM_LABELS**2))),
        lambda at: F.coalesce(F.try_element_at(F.col("_counts"), at), F.lit(0)),
    )
    return cells.groupBy(*by).agg(counts.alias("_counts")).select(*by, dense.alias("cm"))


def _cell(t: int, p: int) -> Column:
    return F.col("cm")[t * NUM_LABELS + p]


def _total(columns) -> Column:
    return reduce(add, columns)


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_matrix(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    """Dense long form: by, y_true, y_pred, n (zero cells included)."""
    entries = [
        F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), _cell(t, p).alias("n"))
        for t in CLASSES
        for p in CLASSES
    ]
    return _matrices(predictions, list(by)).select(*by, F.inline(F.array(*entries)))


def confusion_display(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per true class, one column per predicted class."""
    rows = [
        F.struct(
            F.lit(LABELS[t]).alias("true_label"),
            *[_cell(t, p).alias(f"pred_{LABELS[p]}") for p in CLASSES],
        )
        for t in CLASSES
    ]
    return _matrices(predictions, list(by)).select(*by, F.inline(F.array(*rows)))


def _class_scores(i: int) -> dict[str, Column]:
    hits = _cell(i, i)
    support = _total(_cell(i, p) for p in CLASSES)
    precision = _ratio(hits, _total(_cell(t, i) for t in CLASSES))
    recall = _ratio(hits, support)
    f1 = _ratio(2 * precision * recall, precision + recall)
    return {"precision": precision, "recall": recall, "f1": f1, "support": support}


def _score_structs() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("label_id"),
                F.lit(LABELS[i]).alias("label"),
                *[value.alias(name) for name, value in _class_scores(i).items()],
            )
            for i in CLASSES
        ]
    )


def per_class_scores(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    return _matrices(predictions, list(by)).select(*by, F.inline(_score_structs()))


def metrics(
    predictions: DataFrame, by: list[str] = (), min_support: int = 20, per_class: bool = True
) -> DataFrame:
    """One row of headline metrics per group, with recall, F1 and support per class."""
    scored = _matrices(predictions, list(by)).withColumn("scores", _score_structs())

    def macro(field: str, at_least: int) -> Column:
        chosen = F.filter("scores", lambda s: s["support"] >= at_least)
        total = F.aggregate(chosen, F.lit(0.0), lambda acc, s: acc + s[field])
        return _ratio(total, F.size(chosen))

    everything = _total(_cell(t, p) for t in CLASSES for p in CLASSES)
    safe = _total(_cell(0, p) for p in CLASSES)
    missed = _total(_cell(t, 0) for t in CLASSES if t)
    headline = {
        "n": everything,
        "macro_f1": macro("f1", 1),
        "macro_f1_supported": macro("f1", min_support),
        "n_classes_supported": F.size(F.filter("scores", lambda s: s["support"] >= min_support)),
        "macro_precision": macro("precision", 1),
        "macro_recall": macro("recall", 1),
        "accuracy": _ratio(_total(_cell(i, i) for i in CLASSES), everything),
        "false_positive_rate": _ratio(safe - _cell(0, 0), safe),
        "vulnerable_detection_rate": _ratio(everything - safe - missed, everything - safe),
    }
    if per_class:
        for i, name in enumerate(LABELS):
            for field in ("recall", "f1", "support"):
                headline[f"{field}_{name}"] = F.col("scores")[i][field]
    return scored.select(*by, *[value.alias(name) for name, value in headline.items()])


def benchmark_table(
    predictions: DataFrame, timings: DataFrame | None = None, max_test: int = 0
) -> DataFrame:
    """Every approach on every test set under the same metrics.

    `predictions` is long: approach, test_set, record_id, y_true, y_pred. `timings` may add
    seconds_per_sample by (approach, test_set). `max_test` keeps the first records by id of
    each test set; the rank filter is applied before the shuffle too.
    """
    by = ["approach", "test_set"]
    if max_test:
        rank = F.row_number().over(W.partitionBy(*by).orderBy("record_id"))
        predictions = predictions.withColumn("_rank", rank).filter(F.col("_rank") <= max_test)
    table = metrics(predictions, by, per_class=False)
    return table if timings is None else table.join(timings, by, "left")


def align(predictions: DataFrame, truth: DataFrame, key: str = "record_id") -> DataFrame:
    """Predictions with their true class, matched by record id and never by position."""
    return predictions.join(truth.select(key, "y_true"), key)

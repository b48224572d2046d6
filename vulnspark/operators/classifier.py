"""Classical text classifier: TF-IDF of token 1- to 3-grams into a balanced forest.

The forest sees all of the most frequent terms (`vocabulary`, `forest`). `choose_terms` names those of
them whose presence depends most on the class by the chi-squared statistic; `train_selected_forest` sees
only these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import let, tokens_ml
from vulnspark.operators import forest
from vulnspark.operators.arrow import VECTOR, append_column, list_array, pieces
from vulnspark.operators.vocabulary import Vocabulary, frequent_terms
from vulnspark.session import materialize_alone, work_folder
from vulnspark.taxonomy import NUM_LABELS

SIZES = (1, 2, 3)
#: Digits of the statistic that decide; sums of doubles differ behind them from run to run.
CHI2_DIGITS = 6
#: Bytes of terms that are counted together.
COUNTED_BYTES = 16 << 20


def term_array(code: Column) -> Column:
    """All token 1- to 3-grams of a text, repeats included."""

    def runs(t: Column, k: int) -> Column:
        starts = F.when(F.size(t) >= k, F.sequence(F.lit(1), F.size(t) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda j: F.array_join(F.slice(t, j, k), " "))

    return let(tokens_ml(code), lambda t: F.concat(t, *[runs(t, k) for k in SIZES[1:]]))


def joined_tokens(code: Column) -> Column:
    """A text's tokens joined by spaces, of which no token holds one."""
    return F.coalesce(F.array_join(tokens_ml(code), " "), F.lit(""))


def with_terms(records: DataFrame, code: str = "code") -> DataFrame:
    return records.withColumn("terms", term_array(F.col(code)))


def checked_label(label: str) -> Column:
    """The class id; ids outside the taxonomy are refused, which bounds every table by class."""
    known = F.col(label).between(0, NUM_LABELS - 1)
    return F.when(known, F.col(label)).otherwise(F.raise_error(F.lit("unknown class id"))).cast("int")


def balanced_weights(records: DataFrame, label: str) -> DataFrame:
    """Adds `weight` = rows / (classes x rows of the class); at most seven rows are broadcast."""
    counts = records.groupBy(checked_label(label).alias(label)).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_classes")).first()
    factor = totals["_rows"] / totals["_classes"]
    weights = counts.select(label, (F.lit(factor) / F.col("_n")).alias("weight"))
    return records.join(F.broadcast(weights), label)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_class, terms) of records to the counts of each term of a piece."""
    names = ["term", "tf", "df", *(f"c{c}" for c in range(NUM_LABELS))]
    for piece in (p for batch in batches for p in pieces(batch, COUNTED_BYTES)):
        lists = piece.column("terms")
        coded = lists.flatten().dictionary_encode()
        codes, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        if n:
            record = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            once = np.unique(record * n + codes)
            of_class = piece.column("_class").to_numpy()[once // n].astype(np.int64)
            in_class = np.bincount(of_class * n + once % n, minlength=NUM_LABELS * n).reshape(NUM_LABELS, n)
            sums = [np.bincount(codes, minlength=n), in_class.sum(axis=0), *in_class]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.array(s, pa.int64()) for s in sums)], names=names)


def term_counts(records: DataFrame, label: str, min_df: int = 2) -> DataFrame:
    """(term, tf, df, in_class): occurrences, records, and records per class of every term.

    Terms are counted over Arrow batches first, so a term of any number of occurrences enters the
    sums and the one shuffle once per batch."""
    classes = [f"c{c}" for c in range(NUM_LABELS)]
    schema = ", ".join(["term string", "tf bigint", "df bigint", *(f"{c} bigint" for c in classes)])
    rows = records.select(checked_label(label).alias("_class"), "terms").mapInArrow(_counted, schema)
    counts = rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("tf", "df", *classes)])
    return counts.filter(F.col("df") >= min_df).select(
        "term", "tf", "df", F.array(*[f"c{c}" for c in range(NUM_LABELS)]).alias("in_class")
    )


def chi_squared(df: Column, in_class: Column, n: int, per_class: list[int]) -> Column:
    """Chi-squared of a term's presence against the class, over the 2 x classes table."""
    cells = [
        F.pow(in_class[c] - df * (size / n), 2) * (1 / (df * (size / n)) + 1 / ((n - df) * (size / n)))
        for c, size in enumerate(per_class)
        if size
    ]
    return F.when(df < n, sum(cells[1:], cells[0])).otherwise(0.0)


def choose_terms(
    records: DataFrame, label: str, max_features: int = 50_000, selected: int = 2_000, min_df: int = 2
) -> DataFrame:
    """(term, tf, df, chi2) of the vocabulary, for records with `terms`.

    Of the `max_features` most frequent terms the `selected` ones of greatest chi-squared; ties
    go to the alphabetically first."""
    classes = {r[label]: r.n for r in records.groupBy(checked_label(label).alias(label)).agg(F.count("*").alias("n")).collect()}
    per_class = [classes.get(c, 0) for c in range(NUM_LABELS)]
    if not sum(per_class):
        return term_counts(records, label, min_df).select("term", "tf", "df", F.lit(0.0).alias("chi2")).limit(0)
    frequent = term_counts(records, label, min_df).orderBy(F.desc("tf"), "term").limit(max_features)
    value = F.round(chi_squared(F.col("df"), F.col("in_class"), sum(per_class), per_class), CHI2_DIGITS)
    return frequent.select("term", "tf", "df", value.alias("chi2")).orderBy(F.desc("chi2"), "term").limit(selected)


def tfidf_stages(terms: list[str]) -> list:
    """From `terms` to unit TF-IDF vectors over a vocabulary."""
    return [
        CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="tf"),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features"),
    ]


def tfidf_weights(records: DataFrame, key: str, label: str, **choice) -> DataFrame:
    """(key, term, weight) of each record's TF-IDF vector over the chosen vocabulary."""
    described = with_terms(records)
    terms = [r.term for r in choose_terms(described, label, **choice).collect()]
    if not terms:
        return records.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    vectors = Pipeline(stages=tfidf_stages(terms)).fit(described).transform(described)
    cells = vectors.select(key, F.posexplode(vector_to_array("features")).alias("at", "weight")).filter("weight <> 0")
    return cells.select(key, F.element_at(F.lit(terms), F.col("at") + 1).alias("term"), "weight")


@dataclass
class Forest:
    """A fitted classifier: its terms with their inverse document frequencies, and its trees."""

    terms: list[str]
    idf: np.ndarray
    trees: forest.Trees
    weight: np.ndarray
    n_trees: int
    max_depth: int

    def shares(self) -> np.ndarray:
        """Of each node the weighted share of each class."""
        weighted = self.trees.counts * self.weight
        return weighted / np.maximum(weighted.sum(1, keepdims=True), 1e-300)


def train_forest(
    train: DataFrame,
    label: str = "y_true",
    seed: int = 42,
    trees: int = 300,
    max_features: int = 50_000,
    min_df: int = 2,
    max_depth: int = 12,
) -> Forest:
    """Fit on (code, label). Terms of each size are in one bag; all `max_features` most frequent ones
    are features, and classes weigh alike."""
    folder = work_folder(train.sparkSession)

    def save(df: DataFrame, name: str) -> DataFrame:
        return materialize_alone(df, folder, name)

    texts = save(train.select(checked_label(label).alias("label"), joined_tokens(F.col("code")).alias("joined")), "texts")
    chosen = frequent_terms(texts, max_features, min_df, save)
    rows = texts.count()
    terms, idf = [t for t, _, _ in chosen], np.array([np.log((rows + 1) / (df + 1)) for _, _, df in chosen])
    known = train.sparkSession.sparkContext.broadcast((Vocabulary(terms), idf))
    data = save(forest.blocks(texts, known), "blocks")
    known.unpersist()
    grown, weight = forest.grow(data, len(terms), trees, max_depth, seed, save)
    return Forest(terms, idf, grown, weight, trees, max_depth)


def train_selected_forest(
    train: DataFrame,
    label: str = "y_true",
    seed: int = 42,
    trees: int = 300,
    max_features: int = 50_000,
    selected: int = 2_000,
    min_df: int = 2,
    max_depth: int = 12,
) -> PipelineModel:
    """`train_forest` by Spark ML over the `selected` terms that depend most on the class."""
    weighted = balanced_weights(with_terms(train.select("code", label)), label)
    chosen = choose_terms(weighted, label, max_features, selected, min_df)
    stages = [
        *tfidf_stages([r.term for r in chosen.collect()]),
        RandomForestClassifier(
            labelCol=label,
            weightCol="weight",
            numTrees=trees,
            maxDepth=max_depth,
            seed=seed,
            maxMemoryInMB=1024,
            predictionCol="prediction",
        ),
    ]
    return Pipeline(stages=stages).fit(weighted.drop("code"))


def predict(model: Forest | PipelineModel, records: DataFrame) -> DataFrame:
    """Adds `y_pred` and `logits` (the forest's votes) to the records."""
    if isinstance(model, PipelineModel):
        scored = model.transform(with_terms(records))
        return scored.select(
            *records.columns,
            F.col("prediction").cast("int").alias("y_pred"),
            vector_to_array("rawPrediction").alias("logits"),
        )
    classes = int(np.flatnonzero(model.weight).max(initial=0)) + 1
    known = records.sparkSession.sparkContext.broadcast((model.trees, model.shares(), Vocabulary(model.terms), model.idf))

    def start():
        trees, shares, vocabulary, idf = known.value

        def step(batch: pa.RecordBatch) -> pa.Array:
            votes = forest.votes(trees, shares, model_trees, model_depth, batch.column("_joined"), vocabulary, idf)[:, :classes]
            return list_array(np.full(len(votes), classes), pa.array(votes.ravel()))

        return step

    model_trees, model_depth = model.n_trees, model.max_depth
    scored = append_column(records.withColumn("_joined", joined_tokens(F.col("code"))), "logits", VECTOR, start)
    first = F.array_position("logits", F.array_max("logits")) - 1
    return scored.select(*records.columns, first.cast("int").alias("y_pred"), "logits")

"""Toxicity scores from a counterfactual-regularised classifier.

A logistic regression over the words of a text, their beginnings and how often they occur,
fitted on a bounded sample of labelled texts. Every labelled sentence that names a group is repeated with the name
swapped for each other name of its kind, and the fit pays for the difference of the two
scores, so that a neutral mention of a group does not move the score. Scoring is one pass over
the documents with the fitted weights (at most `FEATURES`) in the task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Memo, Store, rows, text_of

#: Labelled rows of each class the model is fitted on at most, in hash order of their ids.
PER_CLASS = 10_000
FEATURES = 4096
MIN_TEXTS = 5
MIN_Z = 5.0
PREFIXES = (4, 5)
REPEATS = (2, 3)
#: Names that are swapped for each other, by kind.
IDENTITY_TERMS = (
    ("men", "women"),
    ("man", "woman"),
    ("boys", "girls"),
    ("atheists", "buddhists", "christians", "hindus", "jews", "muslims"),
    ("atheist", "buddhist", "christian", "hindu", "jewish", "muslim"),
    ("asian", "black", "latino", "white"),
    ("bisexual", "gay", "heterosexual", "lesbian", "straight", "transgender"),
    ("immigrants", "locals", "natives", "refugees"),
    ("blind", "deaf", "disabled"),
    ("elderly", "old", "young"),
)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s*")
OTHERS = {a: [b for b in kind if b != a] for kind in IDENTITY_TERMS for a in kind}


def word_features(word: str) -> tuple[str, ...]:
    """The word and, of longer words, its beginnings (marked by *)."""
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))


def text_features(words: Iterable[str], features_of: Callable[[str], Iterable[str]] = word_features) -> set[str]:
    """The features of the words; one that occurs 2 or 3 times or more is marked with each number."""
    counts = Counter(f for w in words for f in features_of(w))
    return {*counts, *(f"{f}#{n}" for f, c in counts.items() for n in REPEATS if c >= n)}


def swapped(text: str) -> Counter:
    """Features that the text gains and loses when one name in a sentence is swapped, as
    (gained, lost) with how many swaps do that. Only the counts of the two names' features change,
    so the work is linear in the text; their kinds of change are few, however long it is."""
    if not OTHERS.keys() & set(WORD.findall(text)):
        return Counter()
    sentences = [Counter(WORD.findall(s)) for s in SENTENCE.split(text)]
    total: Counter = Counter()
    for words in sentences:
        for word, n in words.items():
            for f in word_features(word):
                total[f] += n
    swaps = Counter((name, words[name]) for words in sentences for name in OTHERS.keys() & words.keys())
    pairs: Counter = Counter()
    for (name, n), times in swaps.items():
        for other in OTHERS[name]:
            change = Counter(dict.fromkeys(word_features(other), n))
            change.subtract(dict.fromkeys(word_features(name), n))
            gained, lost = [], []
            for f, by in change.items():
                for mark, least in ((f, 1), *((f"{f}#{r}", r) for r in REPEATS)):
                    before, after = total[f] >= least, total[f] + by >= least
                    if before != after:
                        (gained if after else lost).append(mark)
            pairs[tuple(sorted(gained)), tuple(sorted(lost))] += times
    return pairs


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def predicted(self):
        """1 for a toxic text, by the column `score`."""
        return F.when(F.col("score") >= 0.5, 1).otherwise(0)

    def score(self, features: set[str]) -> float:
        total = self.bias + sum(sorted(self.weights[f] for f in features & self.weights.keys()))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


#: Nothing was learned: every text has the same score, below one half.
UNTRAINED = Model({}, -1.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, out = [], []
        for toxic, text in rows(batch):
            label.append(toxic)
            out.append(sorted(text_features(WORD.findall(text.lower()))))
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(out, pa.list_(pa.string()))], names=["toxic", "features"])


def _indexed(index: dict[str, int]):
    """Per labelled text: its class, the numbers of its features, and (gained, lost, times) of its swaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda features: sorted(index[f] for f in features if f in index)
        numbered = pa.list_(pa.int32())
        swap = pa.list_(pa.struct([("gained", numbered), ("lost", numbered), ("times", pa.int64())]))
        for batch in batches:
            label, own, swaps = [], [], []
            for toxic, text in rows(batch):
                low = text.lower()
                label.append(toxic)
                own.append(numbers(text_features(WORD.findall(low))))
                swaps.append([(numbers(a), numbers(b), n) for (a, b), n in swapped(low).items()])
            arrays = [pa.array(label, pa.int32()), pa.array(own, numbered), pa.array(swaps, swap)]
            yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "own", "swaps"])

    return run


def _coordinates(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in lists]
    flat = np.fromiter((i for x in lists for i in x), np.int64, sum(sizes))
    return np.repeat(np.arange(len(lists)), sizes), flat


def fit_weights(
    labels: np.ndarray,
    own: list[list[int]],
    gained: list[list[int]],
    lost: list[list[int]],
    times: np.ndarray,
    n_features: int,
    penalty: float,
    ridge: float = 1e-3,
    steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean log loss + ridge * |w|^2 + penalty * mean (score change)^2,
    by Adam from zero; classes weigh the same. Change i stands for `times[i]` swaps."""
    n = len(labels)
    row, col = _coordinates(own)
    up_row, up_col = _coordinates(gained)
    down_row, down_col = _coordinates(lost)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    w, b = np.zeros(n_features), 0.0
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        margin = b + np.bincount(row, w[col], n)
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) * share
        slope = np.bincount(col, error[row], n_features) + 2 * ridge * w
        if gained:
            change = np.bincount(up_row, w[up_col], len(gained)) - np.bincount(down_row, w[down_col], len(gained))
            pull = 2 * penalty / times.sum() * times * change
            slope += np.bincount(up_col, pull[up_row], n_features) - np.bincount(down_col, pull[down_row], n_features)
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(toxic, text) of at most `per_class` labelled documents of each class. Copies of a text
    count once per class. Only ids are ordered; the chosen ones (bounded) are broadcast."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [known.filter(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    picked = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return picked.select("toxic", "text").dropDuplicates(["toxic", "text"])


def fit(docs: DataFrame, labels: DataFrame, penalty: float = 1.0, per_class: int = PER_CLASS) -> Model:
    """The classifier of `labels` (doc_id, toxic 0 or 1; other values and ids without text do not
    count). Without labelled texts of both classes, or without a feature that tells them apart,
    the model is untrained."""
    sample = Store(docs.sparkSession).save(labelled_sample(docs, labels, per_class), "labelled")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return UNTRAINED
    texts = sample.select("toxic", "text")
    each = texts.mapInArrow(_features, "toxic int, features array<string>").select("toxic", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    pos, neg, n_pos, n_neg = F.col("pos"), F.col("neg"), F.lit(sizes[1]), F.lit(sizes[0])
    rate = (pos + neg) / (n_pos + n_neg)
    z = (pos / n_pos - neg / n_neg) / F.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_neg))
    names = [f for name in OTHERS for f in word_features(name)]
    ranked = counts.filter((rate < 1) & (pos + neg >= MIN_TEXTS)).withColumn("z", F.abs(z))
    strong = ranked.filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(FEATURES)
    telling = [r.feature for r in strong.select("feature").collect()]
    if not telling:
        return UNTRAINED
    index = {f: i for i, f in enumerate(dict.fromkeys([*names, *telling]))}
    kind = "toxic int, own array<int>, swaps array<struct<gained:array<int>,lost:array<int>,times:long>>"
    told = Store(docs.sparkSession).save(texts.mapInArrow(_indexed(index), kind), "told")
    # At most two times per_class rows of at most as many numbers as there are features; swaps only
    # concern the names' features, so their kinds are few.
    seen = sorted(map(tuple, told.select("toxic", "own").collect()))
    each = told.select(F.explode("swaps").alias("s")).groupBy("s.gained", "s.lost").agg(F.sum("s.times").alias("times"))
    swaps = sorted(map(tuple, each.collect()))
    w, b = fit_weights(
        np.array([toxic for toxic, _ in seen], float),
        [own for _, own in seen],
        [gained for gained, _, _ in swaps],
        [lost for _, lost, _ in swaps],
        np.array([n for _, _, n in swaps], float),
        len(index),
        penalty,
    )
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, b)


def _score(model: Model, n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = {f.partition("#")[0] for f in model.weights}
        own = Memo(lambda word: tuple(f for f in word_features(word) if f in bases))
        for batch in batches:
            scores = []
            for text in batch.column(n_keep):
                words = WORD.findall((text.as_py() or "").lower())
                scores.append(model.score(text_features(words, own.__getitem__)))
            columns = [*batch.columns[:n_keep], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n_keep], "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and the score in 0..1 of every whole text; a null text counts as empty."""
    rows_in = docs.select(*keep, text_of(text_col).alias("_text"))
    schema = docs.select(*keep).schema.add("score", "double")
    return rows_in.mapInArrow(_score(model, len(keep)), schema)


def held_out():
    """Rows that never teach: the CRC-32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Fitted on rows that are not held out; the id, labels and other columns never reach a score.
    Rows that repeat an id are scored one by one; a null id is scored and never teaches. Where
    nothing can be learned all scores are one and the same, below one half. Texts of any length are
    read whole, in time linear in their words.
    """
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", model.predicted().alias("predicted")
    )


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted as toxic, with all their columns, in one pass over the texts.
    Where nothing can be learned, from no labels or those of one class, all documents stay."""
    model = fit(docs, labels.filter(~held_out()))
    if model is UNTRAINED:
        return docs
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = score(named, model, named.columns, f"c{docs.columns.index('text')}").filter(model.predicted() == 0)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

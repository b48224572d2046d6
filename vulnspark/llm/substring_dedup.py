"""Removal of repeated passages of a fixed number of words.

Rabin-Karp hashes stand for all windows of `WINDOW` words. Windows whose mark is unique in the
corpus (see `sieve`) are unique; the others are grouped by their two hashes (128 bits) in
Spark, which keeps the first place of each. What starts anywhere else is a repeat, and
overlapping repeats of a document merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Memo, Store, longs, rows, slices, text_of
from vulnspark.llm.sieve import changes, minimizers, repeated_marks, rolling

WINDOW = 20
GRAM = 6


class Words:
    """Words of a text (maximal runs without ASCII white space) as bytes and as hashes."""

    def __init__(self):
        self.hash = Memo(xxhash.xxh64_intdigest, 400_000)

    def __call__(self, text: str) -> tuple[list[bytes], np.ndarray]:
        words = text.encode().split()
        return words, np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))


def _marked(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window, the place of its mark; and all grams' hashes."""
    grams = rolling(hashes, gram)
    return minimizers(grams, window - gram + 1), grams


def _marks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        for batch in slices(batches):
            ids, marks, sizes = batch.column(0), [np.empty(0, np.uint64)], []
            for _, text in rows(batch):
                places, grams = _marked(split(text)[1], window, gram)
                own = grams[places[changes(places)]]
                marks.append(own)
                sizes.append(len(own))
            doc_ids = ids.take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([longs(np.concatenate(marks)), doc_ids], names=["mark", "doc_id"])

    return run


def _windows(window: int, gram: int):
    """Hashes of the windows whose mark is among the document's repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        for batch in slices(batches):
            first, second, starts, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
            for _, text, marks in rows(batch):
                hashes = split(text)[1]
                at = candidates(hashes, marks, window, gram)
                first.append(rolling(hashes, window, 0)[at])
                second.append(rolling(hashes, window, 1)[at])
                starts.append(at)
                sizes.append(len(at))
            doc_ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            start = pa.array(np.concatenate(starts).astype(np.int32))
            columns = [longs(np.concatenate(first)), longs(np.concatenate(second)), doc_ids, start]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id", "start"])

    return run


def candidates(hashes: np.ndarray, marks: list[int], window: int, gram: int) -> np.ndarray:
    """Starts of the windows whose mark is one of `marks`."""
    places, grams = _marked(hashes, window, gram)
    return np.flatnonzero(np.isin(grams[places].view(np.int64), np.array(marks, np.int64)))


def _remove(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        for batch in batches:
            counts, removed, kept = [], [], []
            for _, text, marks, firsts in rows(batch):
                words, hashes = split(text)
                gone = np.zeros(len(words) + 1, np.int64)
                if marks:
                    at = candidates(hashes, marks, window, gram)
                    at = np.setdiff1d(at, np.array(firsts or [], np.int64), assume_unique=True)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                stays = np.cumsum(gone[:-1]) == 0
                counts.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                if removed[-1]:
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                kept.append(b" ".join(words).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (its remaining words, joined by one
    space).

    A word goes if a window over it also starts earlier: in a document of a smaller id, or
    before in the same one. Null and empty texts have no words, texts below one window lose
    none. Rows repeating an id count as one document: equal texts keep the same words. A row of
    a null id neither loses words nor makes others lose any. Other columns are not read; an
    empty table gives no rows.
    """
    store = Store(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    repeated = repeated_marks(texts.mapInArrow(_marks(window, gram), f"mark long, doc_id {kind}"), store)
    some = texts.join(repeated, "doc_id")
    found = some.mapInArrow(_windows(window, gram), f"h1 long, h2 long, doc_id {kind}, start int")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("at.*")
    firsts = store.save(first.groupBy("doc_id").agg(F.collect_set("start").alias("firsts")), "firsts")
    places = repeated.join(firsts, "doc_id", "left")
    every = texts.join(places, "doc_id", "left").select("doc_id", "text", "marks", "firsts")
    return every.mapInArrow(_remove(window, gram), f"doc_id {kind}, n_words long, n_removed long, kept string")


def kept_digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

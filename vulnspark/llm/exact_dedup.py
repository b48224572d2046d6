"""Exact deduplication with a heavy-hitter split.

Every text is reduced to its SHA-256 digest. Misra-Gries counters, kept per task and merged,
name every digest that may hold more than 1/`share` of all rows; the candidates are counted
exactly, and those that pass are broadcast with their winners, so rows of large groups are
decided where they lie. The other digests are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Store, text_of

SHARE = 256
COUNTERS = 1024


def _misra_gries(counters: int):
    """Per task: the digests left after decrements, and (as a null digest) what was decremented."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        lost = 0
        for batch in batches:
            for x in batch.column(0).value_counts():
                key = x["values"].as_py()
                held[key] = held.get(key, 0) + x["counts"].as_py()
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: n - cut for k, n in held.items() if n > cut}
                lost += cut
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*held, None], pa.binary()),
                pa.array([*held.values(), lost], pa.int64()),
            ],
            names=["digest", "n"],
        )

    return run


def frequent(digests: DataFrame, total: int, share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """(digest): fewer than 2 * `share` rows, among them all that hold total/share rows or more.

    A task that saw m rows decrements each digest by at most m / (counters + 1), all tasks
    together by at most total / (counters + 1), and with counters >= 4 * share a digest of
    total/share rows keeps at least 3/4 of them in its counters, which sum to at most total."""
    if counters < 4 * share:
        raise ValueError("counters must be at least four times share")
    seen = digests.select("digest").mapInArrow(_misra_gries(counters), "digest binary, n long")
    sums = seen.filter("digest IS NOT NULL").groupBy("digest").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= F.lit(0.75 * total / share)).select("digest")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, counters: int = COUNTERS
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays. Null texts are empty ones and equal to them. A null
    id loses to any other; a group of null ids only has a null keep_id and keeps its rows.
    Rows repeating both id and text are the same document: they share one decision. Other
    columns of the input are not read, an empty table gives an empty result.
    """
    store = Store(docs.sparkSession)
    key = F.unhex(F.sha2(text_of(text_col), 256)).alias("digest")
    digests = store.save(docs.select(F.col(id_col).alias("id"), key), "digests")
    total = digests.count()
    largest = [F.max("id").alias("keep_id"), F.count("*").alias("group_size")]
    # By the bound of `frequent` below 2 * share rows of 48 bytes.
    hot = F.broadcast(frequent(digests, total, share, counters))
    counted = digests.join(hot, "digest").groupBy("digest").agg(*largest)
    winners = F.broadcast(store.save(counted.filter(F.col("group_size") >= total / share), "winners"))
    heavy = digests.join(winners, "digest")
    light = digests.join(winners.select("digest"), "digest", "left_anti")
    rest = light.join(light.groupBy("digest").agg(*largest), "digest")
    return heavy.unionByName(rest).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; a row of a null id leaves if its text has another id."""
    groups = exact_groups(docs, id_col, text_col)
    gone = groups.filter("NOT kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    same = docs[id_col].eqNullSafe(gone["_id"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == gone["_sha"])
    return docs.join(gone, same, "left_anti")

"""Which windows of a corpus can occur more than once, without shuffling every window.

Every window of `size` units is marked by the gram of least hash inside it (its minimizer).
Equal windows have equal marks, so a window whose mark occurs once in the corpus is unique.
Marks are as few as two in `size - gram` units, and only they are counted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Store

#: Odd multipliers of two independent polynomial hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended as longer texts come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            more = np.uint64(pow(self.base, len(self.up), 2**64)), np.uint64(pow(self.inverse, len(self.up), 2**64))
            self.up = np.concatenate([self.up, self.up * more[0]])
            self.down = np.concatenate([self.down, self.down * more[1]])
        return self.up, self.down


POWERS = tuple(Powers(b) for b in BASES)


def rolling(units: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of all windows of `size` unit hashes (uint64), by differences of prefix sums."""
    n = len(units) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = POWERS[which].reach(len(units) + size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * down[: len(units)], dtype=np.uint64)])
    mixed = (sums[size:] - sums[:-size]) * up[size - 1 : size - 1 + n]
    # The low bits of a product depend on low bits only; the high ones are folded in.
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(BASES[1 - which])
    return mixed ^ (mixed >> np.uint64(32))


def minimizers(grams: np.ndarray, count: int) -> np.ndarray:
    """For every run of `count` grams the place of its least hash, the first of equals."""
    if len(grams) < count:
        return np.empty(0, np.int64)
    low = np.uint64(2**32 - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach < count:
        step = min(reach, count - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return (least & low).astype(np.int64)


def changes(places: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal places."""
    return np.flatnonzero(np.diff(places, prepend=-1))


def repeated_marks(marks: DataFrame, store: Store) -> DataFrame:
    """(doc_id, marks): of every document that has some, the marks that occur more than once.

    `marks` holds (mark, doc_id), one row per occurrence. A mark may hold any share of the
    rows: counts are combined before the shuffle, and the join's large keys are split at run
    time. The list of a document is bounded by its length."""
    own = store.save(marks, "marks")
    # Saved, so that the join has a plain exchange on either side and large keys can be split.
    often = store.save(own.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "often")
    found = own.join(often, "mark")
    lists = store.save(found.groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "repeated")
    store.drop(own, often)
    return lists

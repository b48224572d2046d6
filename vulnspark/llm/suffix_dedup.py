"""Removal of repeated byte strings with suffix arrays.

Windows of `LENGTH` bytes that may repeat are found by their marks (see `sieve`). A segment is
a maximal run of windows with one mark; equal windows have equal marks and so lie in segments
of one mark. Distinct segments are dealt by mark to shards of bounded size. A shard is sorted
by Larsson-Sadakane refinement and its common prefixes are computed by Kasai's scan, both in
numpy: windows that share `LENGTH` bytes with a neighbour repeat. A mark with more segments
than a shard takes is split over several, which are then merged: their distinct windows meet in
ranges of window hashes, where the sorted windows of one shard are searched in those of another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Store, longs, rows, slices, text_of
from vulnspark.llm.sieve import changes, minimizers, repeated_marks, rolling

LENGTH = 200
GRAM = 40
#: Segments of one mark, and bytes, that one suffix array takes.
SEGMENTS = 2_000
SHARD_BYTES = 1 << 20
#: Windows to merge in one batch: they are far more than the segments they come from.
WINDOWS = 1 << 14
#: Ranges of window hashes for each shard of a mark; the windows of one range are merged at once.
RANGES = 16
#: The least numbers of one byte to eight.
BYTES = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
FOUND = (
    "d1 long, d2 long, runs array<int>, mark long, part int, w1 long, w2 long, at int, shard int"  # runs: first and last of each
)


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of `data` (uint8), and their first eight bytes as numbers.

    Larsson-Sadakane: groups of equal prefixes are sorted by the rank of what follows the
    prefix, whose length doubles each round; suffixes alone in their group are left alone."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    heads = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    # Seven bytes, and how many of them there are: the end of the data precedes every byte.
    step = 7
    keys = (heads & ~np.uint64(255)) | np.minimum(np.arange(n, 0, -1), step).astype(np.uint64)
    order = np.argsort(keys)
    starts = np.diff(keys[order], prepend=~keys[order[:1]]) != 0
    rank = np.zeros(n + 1, np.int64)
    rank[order] = own = np.maximum.accumulate(np.where(starts, np.arange(n), 0)) + 1
    at = np.flatnonzero(~(starts & np.append(starts[1:], True)))
    own = own[at]
    del keys
    while len(at):
        mine = order[at]
        follow = rank[np.minimum(mine + step, n)]
        if n < 1 << 21:  # both ranks and the place fit one number
            ranked = own << 42
            follow <<= 21
            ranked |= follow
            ranked |= mine
            ranked.sort()
            mine = ranked & ((1 << 21) - 1)
            ranked >>= 21
        else:
            ranked = (own << 32) | follow
            place = np.argsort(ranked)
            mine, ranked = mine[place], ranked[place]
        order[at] = mine
        starts = np.diff(ranked, prepend=-1) != 0
        rank[mine] = own = np.maximum.accumulate(np.where(starts, at, 0)) + 1
        more = ~(starts & np.append(starts[1:], True))
        at, own = at[more], own[more]
        step *= 2
    return order, heads


def common_prefixes(order: np.ndarray, heads: np.ndarray, first: np.ndarray, last: np.ndarray, most: int) -> np.ndarray:
    """For every place in the order, the prefix its suffix shares with the one before, up to `most`.

    Kasai: the next suffix of the text shares at least one byte less. All segments [first, last)
    are scanned side by side, and prefixes grow by eight bytes at a time."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    lanes = np.argsort(first - last, kind="stable")  # the longest segments first
    first, sizes = first[lanes], (last - first)[lanes]
    held = np.zeros(len(first), np.int64)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -j, "left"))
        at = first[:live] + j
        other = before[at]
        # Up to the end of the data.
        top = np.where(other < 0, 0, np.minimum(n - np.maximum(at, other), most))
        length = np.minimum(np.maximum(held[:live] - 1, 0), top)
        grow = np.flatnonzero(length < top)
        while len(grow):
            known, end = length[grow], top[grow]
            differ = heads[at[grow] + known] ^ heads[other[grow] + known]
            step = 8 - np.searchsorted(BYTES, differ, "right")
            length[grow] = known = np.minimum(known + step, end)
            grow = grow[(step == 8) & (known < end)]
        held[:live] = length
        shared[at] = length
    return shared[order]


def repeated_windows(bodies: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the concatenated bodies: places of all windows (within one body each) by suffix order,
    the number of the class of equal windows of each, and the starts of the bodies."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(bodies), np.uint8)
    order, heads = suffix_array(data)
    classes = np.cumsum(common_prefixes(order, heads, first, first + sizes, length) < length)
    valid = np.zeros(len(data), bool)
    for a, n in zip(first.tolist(), sizes.tolist(), strict=True):
        valid[a : a + max(0, n - length + 1)] = True
    keep = valid[order]
    return order[keep], classes[keep], first


def _runs(flags: np.ndarray) -> np.ndarray:
    """First and last places of the runs of True, one run a row."""
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.column_stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1])


class Shard:
    """Segments of some marks; those of a split mark also give their distinct windows to merge."""

    def __init__(self, length: int):
        self.length, self.segments, self.out, self.size = length, [], [], 0

    def add(self, found: list[tuple]) -> None:
        """Takes the segments of a mark, or of one part of a split mark.

        A segment that has copies repeats whole, and one alone with its mark meets no other: a mark
        of only such segments has nothing to sort."""
        if found[0][1] == 1 and (len(found) == 1 or all(s[5] > 1 for s in found)):
            self.out += [self._whole(s) for s in found if s[5] > 1]
            self.size += 64 * len(found)
        else:
            self.segments += found
            self.size += sum(len(s[-1]) for s in found)

    def _whole(self, segment: tuple) -> tuple:
        return (*segment[3:5], [0, len(segment[-1]) - self.length])

    def result(self) -> Iterator[pa.RecordBatch]:
        merge = self._sort() if self.segments else np.empty(0, np.int64)
        d1, d2, runs = list(zip(*self.out, strict=True)) or [[]] * 3
        yield _found(len(d1), d1=d1, d2=d2, runs=runs)
        if len(merge):
            yield from self._windows(merge)

    def _sort(self) -> np.ndarray:
        """Finds the runs; returns the places of the distinct windows of split marks."""
        bodies = [s[-1] for s in self.segments]
        places, classes, first = repeated_windows(bodies, self.length)
        flags = np.zeros(sum(map(len, bodies)), bool)
        flags[places] = (np.bincount(classes) > 1)[classes]
        # No window starts in the last bytes of a segment, so no run goes on into the next one.
        found = _runs(flags)
        bounds = np.searchsorted(found[:, 0], np.append(first, len(flags))).tolist()
        for k, (_, _, _, d1, d2, copies, _) in enumerate(self.segments):
            if copies > 1:
                self.out.append(self._whole(self.segments[k]))
            elif bounds[k] < bounds[k + 1]:
                self.out.append((d1, d2, (found[bounds[k] : bounds[k + 1]] - first[k]).ravel().tolist()))
        split = np.array([s[1] > 1 for s in self.segments])
        if not split.any():
            return np.empty(0, np.int64)
        one = places[changes(classes)]
        return one[split[np.searchsorted(first, one, "right") - 1]]

    def _windows(self, merge: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The windows at these places of the concatenated bodies, a batch at a time."""
        marks, parts, part, d1, d2 = (np.array([s[c] for s in self.segments], np.int64) for c in range(5))
        sizes = np.array([len(s[-1]) for s in self.segments], np.int64)
        first, data = np.cumsum(sizes) - sizes, b"".join(s[-1] for s in self.segments)
        for start in range(0, len(merge), WINDOWS):
            places = merge[start : start + WINDOWS]
            k = np.searchsorted(first, places, "right") - 1
            digests = b"".join([xxhash.xxh3_128_digest(data[p : p + self.length]) for p in places.tolist()])
            w1, w2 = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
            yield _found(
                len(k), d1=d1[k], d2=d2[k], mark=marks[k], part=_ranges(w1, RANGES * parts[k]), w1=longs(w1), w2=longs(w2), at=places - first[k], shard=part[k]
            )


def _found(n: int, **columns) -> pa.RecordBatch:
    """A batch of `n` rows of FOUND; columns not given are null."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    arrays = [pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _ranges(w1: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of `count` equal ranges of 64-bit numbers, the one each number is in."""
    count, half = count.astype(np.uint64), np.uint64(32)
    low = ((w1 & np.uint64(2**32 - 1)) * count) >> half
    return (((w1 >> half) * count + low) >> half).astype(np.int32)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _marks(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks, sizes = [np.empty(0, np.uint64)], []
            for _, text in rows(batch):
                places, grams = _marked(text.encode(), length, gram)
                own = grams[places[changes(places)]]
                marks.append(own)
                sizes.append(len(own))
            doc_ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([longs(np.concatenate(marks)), doc_ids], names=["mark", "doc_id"])

    return run


def _marked(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = rolling(np.frombuffer(data, np.uint8).astype(np.uint64), gram)
    return minimizers(grams, length - gram + 1), grams


def _segments(length: int, gram: int):
    names = ["mark", "d1", "d2", "doc_id", "start", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in names]
            for doc_id, text, marks in rows(batch):
                data = text.encode()
                places, grams = _marked(data, length, gram)
                starts = changes(places)
                ends = np.append(starts[1:], len(places))
                own = grams[places[starts]].view(np.int64)
                some = np.isin(own, np.array(marks, np.int64))
                for mark, a, b in zip(own[some].tolist(), starts[some].tolist(), ends[some].tolist(), strict=True):
                    body = data[a : b - 1 + length]
                    digest = xxhash.xxh3_128_intdigest(body)
                    for column, value in zip(
                        out, (mark, _signed(digest >> 64), _signed(digest & (2**64 - 1)), doc_id, a, body), strict=True
                    ):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), batch.schema.field(0).type, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _sort_shards(length: int, shard_bytes: int):
    """Rows (mark, parts, part, d1, d2, copies, body) by (mark, part): a shard ends between those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(length), None
        segments = (row for batch in batches for row in rows(batch))
        for (mark, _), found in groupby(segments, lambda s: (s[0], s[2])):
            # Parts of one mark are different shards, else their windows would merge twice.
            if shard.size >= shard_bytes or mark == last:
                yield from shard.result()
                shard = Shard(length)
            last = mark
            shard.add(list(found))
        yield from shard.result()

    return run


def searched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal windows in two sorted lists (w1, w2): the first list searched in the second."""
    low = np.searchsorted(b["w1"], a["w1"], "left")
    high = np.searchsorted(b["w1"], a["w1"], "right")
    found = np.full(len(a), -1, np.int64)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        same = b["w2"][low[open_]] == a["w2"][open_]
        found[open_[same]] = low[open_[same]]
        low[open_] += 1
        open_ = open_[~same & (low[open_] < high[open_])]
    here = np.flatnonzero(found >= 0)
    return here, found[here]


def _merge(table: pa.Table) -> pa.Table:
    """Windows of one range of hashes that stand in several shards of a mark.

    Every shard brings its distinct windows in order. Two shards at a time are merged: those of the
    shorter list are looked up in the longer one by binary search, and what is not found joins it."""
    windows = np.empty(table.num_rows, [("w1", "i8"), ("w2", "i8"), ("row", "i8")])
    windows["row"] = np.arange(table.num_rows)
    for c in ("w1", "w2"):
        windows[c] = table.column(c).to_numpy()
    shard = table.column("shard").to_numpy()
    windows = windows[np.lexsort((windows["w2"], windows["w1"], shard))]
    edges = np.flatnonzero(np.diff(np.sort(shard))) + 1
    lists = sorted(np.split(windows, edges), key=len)
    repeats = np.zeros(table.num_rows, bool)
    while len(lists) > 1:
        short, long = lists[0], lists[1]
        here, there = searched(short, long)
        repeats[short["row"][here]] = repeats[long["row"][there]] = True
        both = np.concatenate([long, np.delete(short, here)])
        lists = sorted([*lists[2:], both[np.lexsort((both["w2"], both["w1"]))]], key=len)
    return table.select(["d1", "d2", "at"]).filter(pa.array(repeats))


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                runs = np.empty((0, 2), np.int64) if found.values is None else found.values.to_numpy().reshape(-1, 2)
                last = len(data) + 1
                gone = np.bincount(runs[:, 0], minlength=last) - np.bincount(runs[:, 1] + length, minlength=last)
                covered = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~covered].tobytes() if len(runs) else data
                values = (len(data), int(covered.sum()), len(_runs(covered)), kept)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeated_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    segments: int = SEGMENTS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte goes if a string of `length` bytes over it also starts anywhere else, in the same
    document too. Null and empty texts have no bytes, texts below `length` lose none, very long ones
    are cut into segments like any other. Rows
    repeating an id lose what any of them repeats at those places; a row of a null id loses
    nothing itself. Other columns are not read; an empty table gives no rows.
    """
    store = Store(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    repeated = repeated_marks(texts.mapInArrow(_marks(length, gram), f"mark long, doc_id {kind}"), store)
    schema = f"mark long, d1 long, d2 long, doc_id {kind}, start long, body binary"
    places = store.save(texts.join(repeated, "doc_id").mapInArrow(_segments(length, gram), schema), "segments")
    # Copies of a segment meet before the sort; a segment of which there are two repeats whole.
    distinct = places.groupBy("mark", "d1", "d2").agg(F.count("*").alias("copies"), F.first("body").alias("body"))
    distinct = store.save(distinct, "distinct")
    parts = distinct.groupBy("mark").agg(F.ceil(F.count("*") / segments).cast("int").alias("parts")).filter("parts > 1")
    dealt = (
        distinct.join(parts, "mark", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod("d1", "parts").cast("int"))
        .select("mark", "parts", "part", "d1", "d2", "copies", "body")
        .repartition("mark", "part")
        .sortWithinPartitions("mark", "part")
    )
    found = store.save(dealt.mapInArrow(_sort_shards(length, shard_bytes), FOUND), "found")
    windows = found.filter("runs IS NULL").select("mark", "part", "d1", "d2", "w1", "w2", "at", "shard")
    across = windows.groupBy("mark", "part").applyInArrow(_merge, "d1 long, d2 long, at int")
    runs = found.filter("runs IS NOT NULL").select("d1", "d2", "runs").unionByName(
        across.groupBy("d1", "d2").agg(F.flatten(F.collect_list(F.array("at", "at"))).alias("runs"))
    )
    by_doc = (
        places.select("d1", "d2", "doc_id", "start")
        .join(runs, ["d1", "d2"])
        .groupBy("doc_id")
        .agg(F.flatten(F.collect_list(F.transform("runs", lambda x: x + F.col("start")))).alias("found"))
    )
    every = texts.join(store.save(by_doc, "by_doc"), "doc_id", "left").select("doc_id", "text", "found")
    return every.mapInArrow(_remove(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def byte_digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

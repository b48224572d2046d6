"""A forest of classification trees over sparse TF-IDF values, grown level by level by all tasks.

Records lie in blocks of a Parquet table: the terms of each record with a non-zero value, and the
values on a scale of 255 steps. A step of the scale is a factor of 2 ** (1 / 16), finer than the 32
bins of a term that Spark ML makes. Zero is below all steps.

Each tree draws its records with replacement (Poisson numbers, made from the seed and the block's
number). Each level deals the terms anew into hands of about the square root of their number, and
each node draws one hand: it tries every threshold of every term of it, as a node of Spark ML does
with its random terms. A block sorted by hand and record has the terms a node needs of a record side
by side, so the work of a level is the records' terms within their nodes' hands, not all terms.

Tasks send what they counted by (node, term, step, class) to shards of nodes and terms; a shard finds
the best split of its part of a node, the driver takes the best of a node's shards. Neither a task
nor a shard holds more than some millions of entries, and the driver holds the trees only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vulnspark.operators.vocabulary import READ_BYTES, Vocabulary, gathered
from vulnspark.taxonomy import NUM_LABELS

#: Records of a block at most, and cells (records x terms) of one.
BLOCK_ROWS, BLOCK_CELLS = 512, 64 << 20
#: Steps of the scale for each factor of two.
STEPS = 16
#: Entries a task holds before it sends them, of how many records at most, and entries of a shard.
HELD, HELD_ROWS, SHARD = 3_000_000, 6_000, 3_000_000
#: Entries whose splits are scored at once.
SCORED = 30_000
#: Bits of an entry: how often the cell occurs, its class, its step.
COUNT_BITS, CLASS_BITS, STEP_BITS = 16, 3, 8
LOW_BITS = COUNT_BITS + CLASS_BITS + STEP_BITS
#: Less gain than this is rounding.
LEAST_GAIN = 1e-12
#: How many times a tree draws a record, by a number of 16 bits.
POISSON = np.searchsorted(np.cumsum(np.exp(-1) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)

BLOCKS = "block bigint, label binary, size binary, term binary, step binary"
#: Best splits of a shard, each column's values as bytes.
SPLITS = {"node": np.int64, "gain": np.float64, "slot": np.int64, "limit": np.int64, "right": np.int64}
SPLIT_ROWS = ", ".join(f"{name} binary" for name in SPLITS)


@dataclass
class Trees:
    """All nodes of all trees; the first ones are the roots. A record goes to `child`, or to the node
    after it when its step of `term` is above `limit`; a leaf is its own child."""

    term: np.ndarray
    limit: np.ndarray
    child: np.ndarray
    counts: np.ndarray

    @classmethod
    def roots(cls, counts: np.ndarray) -> Trees:
        n = len(counts)
        return cls(np.zeros(n, np.int32), np.full(n, 255, np.uint8), np.arange(n, dtype=np.int32), counts)

    def below(self, node: np.ndarray, row: np.ndarray, steps: np.ndarray, rows: int) -> np.ndarray:
        """The nodes one level down; `steps` holds a block's rows by term."""
        return self.child[node] + (steps[self.term[node].astype(np.int64) * rows + row] > self.limit[node])


def tfidf_steps(known: Vocabulary, idf: np.ndarray, joined: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, step) of the non-zero unit TF-IDF values of each text."""
    row, term, n = known.counts(joined)
    value = n * idf[term]
    row, term, value = (x[value > 0] for x in (row, term, value))
    norm = np.sqrt(np.bincount(row, value * value, len(joined)))
    step = np.clip(np.rint(255 + STEPS * np.log2(value / norm[row])), 1, 255)
    return row, term, step.astype(np.uint8)


def block_rows(terms: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(terms, 1)))


def _blocks(vocabulary):
    """(label, joined) to BLOCKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = vocabulary.value
        most, number = block_rows(known.size), TaskContext.get().partitionId() << 32
        for piece in gathered(batches, READ_BYTES):
            label = piece.column("label").to_numpy().astype(np.uint8)
            row, term, step = tfidf_steps(known, idf, piece.column("joined"))
            for at in range(0, len(label), most):
                own = slice(*np.searchsorted(row, (at, at + most)))
                size = np.bincount(row[own] - at, minlength=min(most, len(label) - at)).astype(np.int32)
                blobs = (label[at : at + most], size, term[own].astype(np.int32), step[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
                    names=["block", "label", "size", "term", "step"],
                )
                number += 1

    return run


def blocks(texts: DataFrame, vocabulary) -> DataFrame:
    """BLOCKS of (label, joined); `vocabulary` is a broadcast (Vocabulary, idf)."""
    return texts.select("label", "joined").mapInArrow(_blocks(vocabulary), BLOCKS)


def _drawn(seed: int, block: int, trees: int, rows: int) -> np.ndarray:
    """How many times each tree draws each record of a block."""
    random = np.random.default_rng([seed, block >> 32, block & 0xFFFFFFFF])
    return POISSON[random.integers(0, 1 << 16, (trees, rows), np.uint16)]


def _root_counts(seed: int, trees: int):
    """Blocks to the drawn records by tree and class, their number, and their terms, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, entries = np.zeros((trees, NUM_LABELS), np.int64), 0, 0
        for batch in batches:
            for block, label, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                label, size = np.frombuffer(label, np.uint8), np.frombuffer(size, np.int32)
                drawn = _drawn(seed, block, trees, len(label))
                for c in np.unique(label):
                    total[:, c] += drawn[:, label == c].sum(1, np.int64)
                rows, entries = rows + len(label), entries + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([rows]), pa.array([entries])], names=["counts", "rows", "entries"])

    return run


@dataclass
class Level:
    """What the tasks of one level know beside the trees: the first of its nodes, which nodes are
    open, the hand each node drew, the terms of each hand, and where shards begin."""

    first: int
    open: np.ndarray
    hand: np.ndarray
    hand_of: np.ndarray
    slot_of: np.ndarray
    hands: int
    slot_bits: int
    bounds: np.ndarray


def _merged(entries: np.ndarray) -> np.ndarray:
    """The entries in order, equal ones as one with their sum."""
    entries = np.sort(entries)
    cell = entries >> np.uint64(COUNT_BITS)
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[begins] << np.uint64(COUNT_BITS) | np.add.reduceat(entries & np.uint64((1 << COUNT_BITS) - 1), begins)


def _entries(trees: Trees, level: Level, depth: int, n_trees: int, seed: int, steps: np.ndarray, block: int, label, size, term, step) -> np.ndarray:
    """The entries of a block: for each drawn record and tree the terms of its node's hand. `steps` is
    a zeroed array of a block's cells, and is so again afterwards."""
    rows = len(label)
    row_of = np.repeat(np.arange(rows), size)
    filled = term.astype(np.int64) * rows + row_of
    steps[filled] = step
    drawn = _drawn(seed, block, n_trees, rows)
    node, row = np.nonzero(drawn)
    times = drawn[node, row]
    for _ in range(depth):
        node = trees.below(node, row, steps, rows)
    steps[filled] = 0
    at = np.flatnonzero(node >= level.first)
    at = at[level.open[node[at] - level.first]]
    node, row, times = node[at] - level.first, row[at], times[at]

    sorted_ = np.sort((level.hand_of[term] * rows + row_of).astype(np.uint64) << np.uint64(32) | level.slot_of[term].astype(np.uint64) << np.uint64(STEP_BITS) | step)
    ends = np.cumsum(np.bincount((sorted_ >> np.uint64(32)).astype(np.int64), minlength=level.hands * rows))
    place = level.hand[node].astype(np.int64) * rows + row
    n = np.where(place > 0, ends[place] - ends[place - 1], ends[place])
    upto = np.cumsum(n)
    where = np.repeat(ends[place] - upto, n) + np.arange(int(upto[-1]) if len(upto) else 0)
    own = node.astype(np.uint64) << np.uint64(level.slot_bits + LOW_BITS) | label[row].astype(np.uint64) << np.uint64(COUNT_BITS) | times
    return np.repeat(own, n) + ((sorted_[where] & np.uint64(0xFFFFFFFF)) << np.uint64(COUNT_BITS + CLASS_BITS))


def _counted(state, depth: int, n_trees: int, seed: int):
    """Blocks to (shard, entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, level = state.value
        held, n_held, n_rows = [], 0, 0
        terms = len(level.hand_of)
        steps = np.zeros(terms * block_rows(terms), np.uint8)

        def sent() -> Iterator[pa.RecordBatch]:
            entries = _merged(np.concatenate(held))
            cuts = [0, *np.searchsorted(entries >> np.uint64(LOW_BITS), level.bounds), len(entries)]
            for shard in np.flatnonzero(np.diff(cuts)):
                blob = entries[cuts[shard] : cuts[shard + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "entries"])

        for batch in batches:
            for i in range(batch.num_rows):
                block, *blobs = (c[i] for c in batch.columns)
                label, size, term, step = (np.frombuffer(b.as_buffer(), t) for b, t in zip(blobs, (np.uint8, np.int32, np.int32, np.uint8), strict=True))
                entries = _entries(trees, level, depth, n_trees, seed, steps, block.as_py(), label, size, term, step)
                if held and (n_held + len(entries) > HELD or n_rows + len(label) > HELD_ROWS):
                    yield from sent()
                    held, n_held, n_rows = [], 0, 0
                if len(entries):
                    held.append(entries)
                    n_held, n_rows = n_held + len(entries), n_rows + len(label)
        if held:
            yield from sent()

    return run


def _scored(entries: np.ndarray, totals: np.ndarray, weight: np.ndarray, slot_bits: int) -> list[np.ndarray]:
    """(node, gain, slot, limit, classes on the right) of the best split of each node in ordered
    entries that hold whole terms. Gain is that of Gini impurity over weighted records."""
    cell = (entries >> np.uint64(COUNT_BITS + CLASS_BITS)).astype(np.int64)
    begins = np.flatnonzero(np.diff(cell, prepend=-1))
    group = np.zeros(len(cell), np.int64)
    group[begins[1:]] = 1
    of_class = (entries >> np.uint64(COUNT_BITS)).astype(np.int64) & ((1 << CLASS_BITS) - 1)
    times = (entries & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)
    # A row for each class: sums over classes then add whole rows.
    n = len(begins)
    seen = np.bincount(of_class * n + np.cumsum(group), times, NUM_LABELS * n).reshape(NUM_LABELS, n)
    cell = cell[begins]
    term, step = cell >> STEP_BITS, cell & ((1 << STEP_BITS) - 1)
    # Records with this step of the term or a higher one.
    upto = np.cumsum(seen, axis=1)
    lasts = np.flatnonzero(np.append(term[1:] != term[:-1], True))
    right = np.repeat(upto[:, lasts], np.diff(lasts, prepend=-1), axis=1)
    right -= upto
    right += seen
    node = term >> slot_bits
    own, of = np.unique(node, return_inverse=True)
    whole = totals[own].T * weight[:, None]
    score = lambda x: np.einsum("cn,cn->n", x, x) / np.maximum(x.sum(0), 1e-300)
    r = right * weight[:, None]
    gain = score(r)
    np.subtract(whole[:, of], r, out=r)
    gain += score(r)
    gain = (gain - score(whole)[of]) / whole.sum(0)[of]
    gain[right.sum(0) >= totals[own].sum(1)[of]] = -1
    nodes = np.flatnonzero(np.diff(node, prepend=-1))
    best = np.maximum.reduceat(gain, nodes)
    top = np.flatnonzero(gain == np.repeat(best, np.diff(nodes, append=len(node))))
    top = top[np.diff(node[top], prepend=-1) != 0]
    top = top[gain[top] > LEAST_GAIN]
    # Half of the lowest step, or the middle of the step and the one before.
    before = np.where(np.diff(term, prepend=-1) != 0, np.maximum(step - 2 * STEPS, 0), np.concatenate([[0], step[:-1]]))
    limit = (before + step) // 2
    return [node[top], gain[top], term[top] & ((1 << slot_bits) - 1), limit[top], right[:, top].T.astype(np.int64)]


def _best(state, weight: np.ndarray, slot_bits: int):
    """A shard's entries to the best splits of its nodes."""

    def run(shard: pa.Table) -> pa.Table:
        totals = state.value
        entries = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in shard.column("entries")])
        entries.sort()
        term = entries >> np.uint64(LOW_BITS)
        found, at = [], 0
        while at < len(entries):
            # Whole terms, as many as are scored at once.
            upto = min(at + SCORED, len(entries))
            if upto < len(entries):
                upto = int(np.searchsorted(term, term[upto - 1], "right"))
            found.append(_scored(entries[at:upto], totals, weight, slot_bits))
            at = upto
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        blobs = [c.astype(kind).tobytes() for c, kind in zip(columns, SPLITS.values(), strict=True)]
        return pa.table([pa.array([b], pa.binary()) for b in blobs], names=list(SPLITS))

    return run


def _dealt(seed: int, depth: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hand and place in it of each term, the term by hand and place, and how many hands."""
    random = np.random.default_rng([seed, depth, 1])
    hands = max(1, terms // max(1, int(np.ceil(np.sqrt(terms)))))
    dealt = random.permutation(terms)
    hand, slot = np.zeros(terms, np.int32), np.zeros(terms, np.int32)
    hand[dealt], slot[dealt] = np.arange(terms) % hands, np.arange(terms) // hands
    back = np.zeros((hands, -(-terms // hands)), np.int32)
    back[hand, slot] = np.arange(terms)
    return hand, slot, back, hands


def grow(data: DataFrame, terms: int, n_trees: int, max_depth: int, seed: int, save) -> tuple[Trees, np.ndarray]:
    """The trees over a saved table of BLOCKS, and the weight of each class (records / (classes x
    records of the class)). `save` cuts lineage and frees a step's shuffle files."""
    context = data.sparkSession.sparkContext
    labels = data.select("label").mapInArrow(_class_counts, "n array<bigint>").collect()
    sizes = np.array([r.n for r in labels], np.int64).reshape(-1, NUM_LABELS).sum(0)
    weight = np.divide(sizes.sum() / max((sizes > 0).sum(), 1), sizes, out=np.zeros(NUM_LABELS), where=sizes > 0)
    parts = data.select("block", "label", "size").mapInArrow(_root_counts(seed, n_trees), "counts binary, rows bigint, entries bigint").collect()
    trees = Trees.roots(sum(np.frombuffer(p.counts, np.int64).reshape(n_trees, NUM_LABELS) for p in parts))
    n_rows, n_entries = sum(p.rows for p in parts), sum(p.entries for p in parts)
    first = 0
    for depth in range(max_depth if terms else 0):
        totals = trees.counts[first:]
        is_open = (totals > 0).sum(1) > 1
        if not is_open.any():
            break
        hand_of, slot_of, term_at, hands = _dealt(seed, depth, terms)
        slots = term_at.shape[1]
        slot_bits = slots.bit_length()
        if len(totals).bit_length() + slot_bits + LOW_BITS > 64:
            raise ValueError("too many nodes for the bits of an entry")
        # Shards of about as many entries each: a node has them as it has records.
        drawn = np.cumsum(np.where(is_open, totals.sum(1), 0))
        shards = max(1, min(int(drawn[-1] * (n_entries / max(n_rows, 1)) / hands / SHARD) + 1, 1 << 20))
        aims = drawn[-1] * np.arange(1, shards) / shards
        of = np.searchsorted(drawn, aims, "right").clip(max=len(drawn) - 1)
        begun = drawn[of] - np.where(is_open, totals.sum(1), 0)[of]
        part = (aims - begun) / np.maximum(drawn[of] - begun, 1)
        bounds = (of.astype(np.uint64) << np.uint64(slot_bits)) + (part * slots).astype(np.uint64)
        hand = np.random.default_rng([seed, depth, 2]).integers(0, hands, len(totals), np.int32)
        level = Level(first, is_open, hand, hand_of, slot_of, hands, slot_bits, bounds)
        state, known = context.broadcast((Trees(trees.term, trees.limit, trees.child, trees.counts[:0]), level)), context.broadcast(totals)
        counted = data.mapInArrow(_counted(state, depth, n_trees, seed), "shard int, entries binary")
        best = save(counted.groupBy("shard").applyInArrow(_best(known, weight, slot_bits), SPLIT_ROWS), "splits").collect()
        columns = [
            np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in best)])
            for name, kind in SPLITS.items()
        ]
        state.unpersist(), known.unpersist()
        node, gain, slot, limit, right = columns
        right = right.reshape(-1, NUM_LABELS)
        order = np.lexsort((limit, slot, -gain, node))
        order = order[np.diff(node[order], prepend=-1) != 0]
        node, slot, limit, right = node[order], slot[order], limit[order], right[order]
        trees.term[first + node] = term_at[hand[node], slot]
        trees.limit[first + node] = limit
        n = len(trees.term)
        trees.child[first + node] = n + 2 * np.arange(len(node))
        more = Trees.roots(np.stack([totals[node] - right, right], 1).reshape(-1, NUM_LABELS))
        first = n
        trees = Trees(
            np.concatenate([trees.term, more.term]), np.concatenate([trees.limit, more.limit]),
            np.concatenate([trees.child, n + more.child]), np.concatenate([trees.counts, more.counts]),
        )
        if not len(node):
            break
    return trees, weight


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(NUM_LABELS, np.int64)
    for batch in batches:
        for label in batch.column("label").to_pylist():
            total += np.bincount(np.frombuffer(label, np.uint8), minlength=NUM_LABELS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])


def votes(trees: Trees, share: np.ndarray, n_trees: int, depth: int, joined: pa.Array, known: Vocabulary, idf: np.ndarray) -> np.ndarray:
    """Per text the sum of its leaves' class shares over all trees."""
    row, term, step = tfidf_steps(known, idf, joined)
    most = block_rows(known.size)
    out = np.zeros((len(joined), NUM_LABELS))
    for at in range(0, len(joined), most):
        rows = min(most, len(joined) - at)
        own = slice(*np.searchsorted(row, (at, at + rows)))
        steps = np.zeros(max(known.size, 1) * rows, np.uint8)
        steps[term[own] * rows + row[own] - at] = step[own]
        here = np.arange(rows)
        for tree in range(n_trees):
            node = np.full(rows, tree)
            for _ in range(depth):
                node = trees.below(node, here, steps, rows)
            out[at : at + rows] += share[node]
    return out

"""Best-fit packing of token sequences.

Documents become token ids once, in tasks; only lengths and places travel further. Best-fit
decreasing needs the lengths alone: a segment tree over the remaining capacities 0..size says
which capacity has open bins, and the tightest one that fits is found in logarithmic time.
Pieces of one length are interchangeable, so they are placed in runs and the plan has at most
a few thousand runs whatever the number of documents. Each piece finds its run by its rank
among the pieces of its length, which Spark counts in salted groups.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vulnspark.llm.common import Memo, Store, rows

SIZE = 1024
END = 2
GROUP = 4_000


#: Splits words, numbers, signs and white space before merging; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space from this length on are left to `tokenizers`: the matcher of `tiktoken` keeps
#: a place for each character of a run and ends the process at about a million.
LONG_RUN = 10_000
RUN = re.compile(rf"\s{{{LONG_RUN}}}")
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte strings by id. The file writes a printable byte as its character and the others,
    in order, as the characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte[c] for c in word): i for word, i in vocabulary.items()}


class Ids:
    """Little-endian unsigned 32-bit ids of texts, for a byte-level BPE file of `tokenizers`.

    The pattern never joins characters across a single space between two that are no white
    space, so such words have the same ids alone, and frequent ones are encoded once. Merging
    with `tiktoken` over the file's vocabulary gives the same ids as `tokenizers` (tested) in
    a third of the time. Texts with long runs of white space are left to `tokenizers`, and so are
    those that hold an added token, unless `encode_special_tokens` takes its characters as text
    (as the setting of that name does there, where it is off by default)."""

    def __init__(self, tokenizer_path: str, encode_special_tokens: bool = True):
        self.tokenizer = tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = encode_special_tokens
        tokens = tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in tokens if not (t.special and encode_special_tokens)]
        ranks = byte_ranks(tokenizer.get_vocab(with_added_tokens=False))
        added = {t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()}
        ranks = {word: i for word, i in ranks.items() if word not in added}
        self.merger = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo = Memo(lambda word: self.encode(" " + word), 400_000)

    def slow(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if len(text) >= LONG_RUN and RUN.search(text):
            return self.slow(text)
        return array("I", self.merger.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self.slow(text)
        if "  " in text or any(c in text and (f"{c} " in text or f" {c}" in text) for c in WHITE):
            return self.encode(text)
        first, *words = text.split(" ")
        return b"".join([self.encode(first), *map(self.memo.__getitem__, words)])


def _cut(tokenizer_path: str, size: int, end: int):
    schema = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = Ids(tokenizer_path, encode_special_tokens=False), np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text in rows(batch):
                data = ids(text or "") + last
                total = len(data) // 4
                count = -(-total // size)
                for piece in range(count):
                    stop = total - (count - 1 - piece) * size
                    start = max(0, stop - size)
                    crc = zlib.crc32(data[start * 4 : stop * 4])
                    for column, value in zip(out, (doc_id, piece, start, stop - start, crc), strict=True):
                        column.append(value)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=schema)

    return run


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end: int = END,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. A document is its ids, as the tokenizer gives them
    by default (an added token in the text is that token), and the id `end`; longer
    ones than `size` are cut so that only the first piece is shorter."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_col, text_col).mapInArrow(_cut(tokenizer_path, size, end), schema)


class Capacities:
    """Segment tree over remaining capacities: True where bins of that capacity are open."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        node = self.leaves + capacity
        self.open[node] = is_open
        while node := node // 2:
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least `length` that has open bins."""
        node = self.leaves + length
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.open[2 * node])
                return node - self.leaves
            node //= 2
        return None


def best_fit(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best-fit decreasing over `counts` pieces of each length, in runs.

    Rows (length, first_rank, first_bin, per_bin, offset): from first_rank on, the pieces of
    that length fill bins from first_bin, per_bin to a bin, the first at offset."""
    tree = Capacities(size)
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)
    bins, runs = 0, []

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            held[capacity].append((first, count))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"length {length} is not within 1..{size}")
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, new = size, -(-left // (size // length))
                first, count = bins, new
                bins += new
            else:
                first, count = held[capacity].pop()
                tree.mark(capacity, bool(held[capacity]))
            # A bin that takes one piece stays the tightest until no other piece fits.
            per_bin = capacity // length
            full = min(count, left // per_bin)
            rest = min(left - full * per_bin, per_bin) if full < count else 0
            placed = full * per_bin + rest
            runs.append((length, rank, first, per_bin, size - capacity))
            put(capacity - per_bin * length, first, full)
            if rest:
                put(capacity - rest * length, first + full, 1)
            put(capacity, first + full + bool(rest), count - full - bool(rest))
            left, rank = left - placed, rank + placed
    return np.array(runs, np.int64).reshape(-1, 5)


def _place(runs: np.ndarray):
    """`runs` sorted by (length, first_rank); a piece's run is the last that is not beyond it."""
    keys = runs[:, 0] << 48 | runs[:, 1]
    order = np.argsort(keys)
    keys, runs = keys[order], runs[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            mine = runs[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            nth, per_bin = rank - mine[:, 1], np.maximum(mine[:, 3], 1)
            columns = batch.columns[:5] + [
                pa.array(mine[:, 2] + nth // per_bin),
                pa.array(mine[:, 4] + nth % per_bin * length),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end: int = END,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the id `end` alone; a null id is kept; rows repeating an id are
    packed one by one; other columns are not read; an empty table gives no rows. `group` is about
    how many pieces of a length are ranked together; each length is salted by its own count, and no
    piece is left out. Very long texts are whole, in pieces.
    """
    store = Store(docs.sparkSession)
    cut = store.save(pieces(docs, tokenizer_path, id_col, text_col, size, end), "pieces")
    # At most `size` rows.
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = F.lit([max(1, -(-counts.get(n, 0) // group)) for n in range(size + 1)])
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.element_at(salts, F.col("length").cast("int") + 1))
    salted = cut.withColumn("salt", salt)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("nth", F.row_number().over(within))
        .join(bases, ["length", "salt"])
        .select(*cut.columns, (F.col("base") + F.col("nth") - 1).alias("rank"))
    )
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_place(best_fit(counts, size)), schema)

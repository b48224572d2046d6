"""The most frequent token 1- to 3-grams of texts, and their TF-IDF values.

Texts come as tokens joined by spaces (no token holds one), so a term is a slice of its text and no
list of terms is ever built. A first pass adds all occurrences up in buckets of two hash tables, and
counts the terms that are frequent within a piece of text. The latter bound the least frequency of
the terms asked for from below; a term is counted exactly, in a second pass, if both of its buckets
reach that bound. No term as frequent as the bound is lost, whatever the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.operators.arrow import pieces

SIZES = (1, 2, 3)
#: Bytes of text whose terms are counted together, and of text that is looked up together.
COUNTED_BYTES, READ_BYTES = 8 << 20, 4 << 20
#: Times a term occurs in a piece of text that names it.
LEAST = 4
#: Buckets of a hash table, as a power of two, and buckets that are added up together.
TABLE_BITS, PART_BITS = 22, 15
N_BUCKETS, N_PARTS = 1 << TABLE_BITS, 1 << TABLE_BITS - PART_BITS
#: Odd numbers that mix hashes: of bytes, of the tokens of a run by their place, of the two tables.
ODD_BYTE, ODD_MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
ODD_PLACE = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
ODD_TABLE = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
#: Bits of the table that tells most unknown runs of tokens from known ones.
FILTER_BITS = 20


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about `most` bytes, whatever their own size is."""
    held, size = [], 0
    for piece in (p for batch in batches for p in pieces(batch, most)):
        if held and size + piece.nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if piece.num_rows:
            held.append(piece)
            size += piece.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tokens(joined: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens, and of each token its number among them and its text's row."""
    lists = pc.split_pattern(joined.cast(pa.large_string()), " ")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # an empty text splits into one empty token
    row, coded = row[full], flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), row


def _runs(token: np.ndarray, row: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, place, number) of the k-token runs within a text; equal runs have equal numbers."""
    key = token
    for k in SIZES:
        if k > 1:
            if len(key) and int(key.max()) >= (1 << 62) // n:
                key = np.unique(key, return_inverse=True)[1]
            key = key[: len(token) - k + 1] * n + token[k - 1 :]
        place = np.flatnonzero(row[: max(len(row) - k + 1, 0)] == row[k - 1 :])
        yield k, place, key[place]


def _spelled(words: pa.Array, token: np.ndarray, place: np.ndarray, k: int) -> pa.Array:
    """The terms of the k-token runs that begin at these places."""
    parts = [words.take(pa.array(token[place + i])) for i in range(k)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def _hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; the same word has the same one anywhere."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]].astype(np.uint64)
    at = at - at[0]
    sizes = np.diff(at)
    powers = np.cumprod(np.full(int(sizes.max()), ODD_BYTE))
    raw = (raw + np.uint64(1)) * powers[np.arange(len(raw)) - np.repeat(at[:-1], sizes)]
    sums = np.add.reduceat(raw, at[:-1])
    return (sums ^ sums >> np.uint64(29)) * ODD_MIX


def _buckets(hashes: np.ndarray, table: int) -> Iterator[np.ndarray]:
    """The bucket in a table of the k-token run that begins at each place, for each k."""
    total = np.zeros(len(hashes), np.uint64)
    for k in SIZES:
        total = total[: max(len(hashes) - k + 1, 0)] + (hashes[k - 1 :] ^ ODD_MIX) * ODD_PLACE[k - 1]
        mixed = (total ^ total >> np.uint64(31)) * ODD_TABLE[table]
        yield (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _counted(words: pa.Array, token: np.ndarray, row: np.ndarray, among) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(term, tf, df) of the runs at the places where `among`, an array for each k, is true."""
    for (k, place, key), own in zip(_runs(token, row, len(words) + 1), among, strict=True):
        kept = own[place]
        place, key = place[kept], key[kept]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        begins = np.flatnonzero(np.diff(ordered, prepend=-1))
        # Of a term's places, in order, those in another text than the one before.
        fresh = np.diff(row[place[order]], prepend=-1) != 0
        fresh[begins] = True
        df = np.add.reduceat(fresh.astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
        yield _spelled(words, token, place[order[begins]], k), np.diff(begins, append=len(ordered)), df


FIRST = "term string, tf bigint, part int, low binary, at binary, high binary"


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (term, tf) of the terms with `LEAST` occurrences in a piece, and to the sums of each
    part of the tables: their low bytes, and what is above them where it is not zero."""
    names = ["term", "tf", "part", "low", "at", "high"]
    sums = [np.zeros(N_BUCKETS, np.int64) for _ in ODD_TABLE]
    for piece in gathered(batches, COUNTED_BYTES):
        words, token, row = _tokens(piece.column("joined"))
        hashes = _hashed(words)[token] if len(words) else np.zeros(0, np.uint64)
        valid = [row[: max(len(row) - k + 1, 0)] == row[k - 1 :] for k in SIZES]
        often = None
        for table, total in enumerate(sums):
            buckets = list(_buckets(hashes, table))
            here = np.zeros(N_BUCKETS, np.int64)
            for b, v in zip(buckets, valid, strict=True):
                here += np.bincount(b[v], minlength=N_BUCKETS)
            total += here
            if often is None:
                often = [here[b] >= LEAST for b in buckets]
        for term, tf, _ in _counted(words, token, row, often):
            named = tf >= LEAST
            term, tf = term.filter(pa.array(named)).cast(pa.string()), tf[named]
            nulls = [pa.nulls(len(tf), t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([term, pa.array(tf, pa.int64()), *nulls], names=names)
    for part in range(N_PARTS * len(sums)):
        own = sums[part // N_PARTS][(part % N_PARTS) << PART_BITS : (part % N_PARTS + 1) << PART_BITS]
        if own.any():
            at = np.flatnonzero(own >> 8)
            blobs = [(own & 255).astype(np.uint8), at.astype(np.int32), own[at] >> 8]
            row = [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)]
            yield pa.RecordBatch.from_arrays(row, names=names)


def _reached(bound: int):
    """The sums of one part to a bit for each bucket that reaches the bound."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << PART_BITS, np.int64)
        for low, at, high in zip(*(table.column(c) for c in ("low", "at", "high")), strict=True):
            total += np.frombuffer(low.as_buffer(), np.uint8)
            total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(high.as_buffer(), np.int64) << 8
        return pa.table([table.column("part")[:1], pa.array([np.packbits(total >= bound).tobytes()], pa.binary())], names=["part", "bits"])

    return run


def _second(reached):
    """Texts to (term, tf, df) of the terms both of whose buckets reached the bound, for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.unpackbits(np.frombuffer(b, np.uint8)).view(bool) for b in reached.value]
        for piece in gathered(batches, COUNTED_BYTES):
            words, token, row = _tokens(piece.column("joined"))
            hashes = _hashed(words)[token] if len(words) else np.zeros(0, np.uint64)
            one, two = ([own[b] for b in _buckets(hashes, i)] for i, own in enumerate(tables))
            for term, tf, df in _counted(words, token, row, [a & b for a, b in zip(one, two, strict=True)]):
                columns = [term.cast(pa.string()), pa.array(tf, pa.int64()), pa.array(df, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "tf", "df"])

    return run


def frequent_terms(texts: DataFrame, most: int, min_df: int, save) -> list[tuple[str, int, int]]:
    """(term, tf, df) of the `most` most frequent terms found in `min_df` texts or more; of equally
    frequent ones the alphabetically first. `texts` has the column `joined`; `save` cuts lineage."""
    joined, wanted = texts.select("joined"), most
    context = joined.sparkSession.sparkContext
    first = save(joined.mapInArrow(_first, FIRST), "first")
    named = save(first.filter("term IS NOT NULL").groupBy("term").agg(F.sum("tf").alias("tf")).select("tf"), "named")
    while True:
        top = named.orderBy(F.desc("tf")).limit(wanted).agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
        bound = top.tf if top.n == wanted and wanted else 1
        bits = {r.part: r.bits for r in first.filter("part IS NOT NULL").groupBy("part").applyInArrow(_reached(bound), "part int, bits binary").collect()}
        none = bytes(1 << PART_BITS - 3)
        reached = context.broadcast([b"".join(bits.get(t * N_PARTS + p, none) for p in range(N_PARTS)) for t in range(len(ODD_TABLE))])
        counts = joined.mapInArrow(_second(reached), "term string, tf bigint, df bigint")
        counts = counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        found = save(counts.filter((F.col("df") >= min_df) & (F.col("tf") >= bound)).orderBy(F.desc("tf"), "term").limit(most), "terms").collect()
        reached.unpersist()
        if len(found) == most or bound == 1:
            return sorted(((r.term, r.tf, r.df) for r in found), key=lambda r: (-r[1], r[0]))
        wanted *= 2  # many frequent terms are in too few texts


class Vocabulary:
    """Finds given terms in texts; a term's number is its place in the list."""

    def __init__(self, terms: list[str]):
        self.size = len(terms)
        split = [t.split(" ") for t in terms]
        words = sorted({w for parts in split for w in parts})
        number = {w: i for i, w in enumerate(words, 1)}
        self.words, self.n = pa.array(words, pa.large_string()), len(words) + 1
        if self.n >= 1 << 21:
            raise ValueError("too many different tokens for one vocabulary")
        self.known = {}
        for k in SIZES:
            at = [i for i, parts in enumerate(split) if len(parts) == k]
            key = np.zeros(len(at), np.int64)
            for j in range(k):
                key = key * self.n + np.array([number[split[i][j]] for i in at], np.int64)
            order = np.argsort(key)
            passes = np.zeros(1 << FILTER_BITS, bool)
            passes[self._slot(key)] = True
            self.known[k] = key[order], np.array(at, np.int64)[order], passes

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * ODD_MIX) >> np.uint64(64 - FILTER_BITS)

    def counts(self, joined: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) of the known terms of each text, by row and term."""
        words, token, row = _tokens(joined)
        ours = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64) + 1
        token = ours[token] if len(words) else token
        found = []
        key = token
        for k in SIZES:
            if k > 1:
                key = key[: len(token) - k + 1] * self.n + token[k - 1 :]
            keys, terms, passes = self.known[k]
            if not len(keys) or len(key) == 0:
                continue
            at = np.flatnonzero(passes[self._slot(key)] & (row[: len(key)] == row[k - 1 :]))
            mine = key[at]
            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            right = keys[place] == mine
            found.append(row[at[right]] * self.size + terms[place[right]])
        every = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        begins = np.flatnonzero(np.diff(every, prepend=-1))
        cells = every[begins]
        return cells // max(self.size, 1), cells % max(self.size, 1), np.diff(begins, append=len(every))

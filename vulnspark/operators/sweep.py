"""Points inside intervals by one sorted sweep: hits inside chunks, without repeating a chunk.

Chunks and hits go together through one range shuffle by (file, line), so a file of any length or
with most of the rows spreads over many tasks. A task sweeps its range once and keeps only the chunks
that are open. A chunk that reaches beyond its range is met by the hits there in a small join: those
are the chunks open at the border of two ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.operators.arrow import PIECE_BYTES, pieces
from vulnspark.session import materialize, work_folder

CHUNK, HIT = 0, 1


def _pairs(groups: np.ndarray, lines: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> tuple[list, list, list]:
    """(chunk, hit) places of sorted events, and the chunks still open behind the last one."""
    chunks, hits, open_, group = [], [], [], None
    for i, (g, line, kind, end) in enumerate(zip(groups.tolist(), lines.tolist(), kinds.tolist(), ends.tolist(), strict=True)):
        if g != group:
            open_, group = [], g
        if kind == CHUNK:
            open_.append((end, i))
            continue
        open_ = [c for c in open_ if c[0] >= line]
        chunks += [c for _, c in open_]
        hits += [i] * len(open_)
    # Later events of the group have no smaller line, so chunks that end before it meet no more hits.
    return chunks, hits, [c for end, c in open_ if end >= line]


def _row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of every row; of lists and maps the mean."""
    if pa.types.is_struct(column.type):
        return sum((_row_bytes(c) for c in column.flatten()), np.zeros(len(column)))
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 8.0
    return np.full(len(column), column.nbytes / max(1, len(column)))


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of entries of at most `most` bytes together, or of one entry."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def _sweep(n_keys: int):
    """Batches of (keys, line, kind, end, chunk, hit) in order to (keys, chunk, hit) of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (piece for batch in batches for piece in pieces(batch)):
            table = pa.Table.from_batches([batch])
            # Open chunks of earlier batches stand in front, so they are swept again as chunks.
            table = table if held is None else pa.concat_tables([held, table])
            table = table.combine_chunks()
            keys = [table.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in range(n_keys)]
            changed = np.zeros(table.num_rows, bool)
            for codes in keys:
                changed |= np.diff(codes, prepend=codes[:1]) != 0
            line, kind, end = (table.column(n_keys + k).to_numpy() for k in range(3))
            chunks, hits, open_ = _pairs(np.cumsum(changed), line, kind, end)
            held = table.take(pa.array(open_, pa.int64()))
            # A chunk comes with each of its hits, so pairs can be far larger than the events.
            whole_bytes, hit_bytes = (_row_bytes(table.column(n_keys + k).combine_chunks()) for k in (3, 4))
            for a, b in _runs(whole_bytes[chunks] + hit_bytes[hits], PIECE_BYTES) if hits else ():
                found = table.take(pa.array(hits[a:b], pa.int64()))
                whole = table.column(n_keys + 3).take(pa.array(chunks[a:b], pa.int64()))
                columns = [*(found.column(k) for k in range(n_keys)), whole, found.column(n_keys + 4)]
                names = [*table.column_names[:n_keys], "chunk", "hit"]
                yield from pa.table(columns, names=names).combine_chunks().to_batches()

    return run


def hits_in_chunks(chunks: DataFrame, hits: DataFrame, file_keys: list[str]) -> DataFrame:
    """`labeling.hits_in_chunks`: hits whose line falls inside a chunk of the same file, bounds included.

    Columns: the keys, the chunk's others, the hit's others. Rows with a null key or line meet nothing."""
    of_chunk = [c for c in chunks.columns if c not in file_keys]
    of_hit = [c for c in hits.columns if c not in file_keys]
    keys = [F.col(k).alias(f"_key{i}") for i, k in enumerate(file_keys)]
    named = [f"_key{i}" for i in range(len(file_keys))]
    events = chunks.select(
        *keys, F.col("start_line").cast("long").alias("line"), F.lit(CHUNK).alias("kind"),
        F.col("end_line").cast("long").alias("end"), F.struct(*of_chunk).alias("chunk"),
    ).unionByName(
        hits.select(
            *keys, F.col("line").cast("long").alias("line"), F.lit(HIT).alias("kind"),
            F.lit(-1).cast("long").alias("end"), F.struct(*of_hit).alias("hit"),
        ),
        allowMissingColumns=True,
    )
    events = events.dropna(subset=[*named, "line", "end"])
    dealt = events.repartitionByRange(*named, "line", "kind").sortWithinPartitions(*named, "line", "kind")
    stored = materialize(dealt.withColumn("part", F.spark_partition_id()), work_folder(chunks.sparkSession), "events")
    swept = _in_ranges(stored, named)
    across = _across_ranges(stored, named)
    both = swept.unionByName(across)
    return both.select(*[F.col(n).alias(k) for n, k in zip(named, file_keys, strict=True)], "chunk.*", "hit.*")


def _in_ranges(stored: DataFrame, named: list[str]) -> DataFrame:
    """Pairs inside one range; ranges that meet in a task are kept apart by their number."""
    keys = ["part", *named]
    schema = T.StructType([stored.schema[c] for c in [*keys, "chunk", "hit"]])
    ordered = stored.repartition("part").sortWithinPartitions(*keys, "line", "kind")
    columns = [*keys, "line", "kind", "end", "chunk", "hit"]
    return ordered.select(*columns).mapInArrow(_sweep(len(keys)), schema).drop("part")


def _across_ranges(stored: DataFrame, named: list[str]) -> DataFrame:
    """Chunks that reach into later ranges with the hits there.

    Only files on the border of two ranges have such chunks; there are fewer of those than ranges."""
    hits = stored.filter(F.col("kind") == HIT)
    spans = stored.groupBy(*named, "part").agg(F.min(F.when(F.col("kind") == HIT, F.col("line"))).alias("first"))
    wide = spans.withColumn("_n", F.count("*").over(W.partitionBy(*named))).filter("_n > 1 AND first IS NOT NULL")
    later = wide.select(*named, F.col("part").alias("later"), "first")
    reach = stored.filter(F.col("kind") == CHUNK).select(*named, "part", "end", "chunk")
    carried = reach.join(later, named).filter((F.col("later") > F.col("part")) & (F.col("first") <= F.col("end")))
    carried = carried.select(*named, F.col("later").alias("part"), "end", "chunk")
    met = carried.join(hits.select(*named, "part", "line", "hit"), [*named, "part"])
    return met.filter(F.col("line") <= F.col("end")).select(*named, "chunk", "hit")

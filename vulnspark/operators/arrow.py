"""Python steps over Arrow batches that add one column and pass the others through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())


#: Bytes of a batch that are turned into Python objects at once.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes, or of one row. What a step holds then depends on
    neither the rows a batch has, which the session sets, nor their length."""
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), most)
        yield from pieces(batch.slice(half), most)
    else:
        yield batch


def append_column(
    df: DataFrame,
    name: str,
    data_type: T.DataType,
    start: Callable[[], Callable[[pa.RecordBatch], pa.Array]],
) -> DataFrame:
    """Adds a column computed per batch. `start` runs once per task and returns the step.

    A plan node rather than a Python expression: its input columns are computed in the JVM
    below it whatever expressions they hold, and the other columns are not copied.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, data_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for piece in pieces(batch):
                columns = [*piece.columns, step(piece)]
                yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, name])

    return df.mapInArrow(run, schema)


def list_array(sizes: np.ndarray, flat: pa.Array) -> pa.ListArray:
    """Lists of the given sizes over consecutive values."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, flat)

"""What the operators share: saved tables in the shared folder and Arrow row access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.session import work_folder

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Tables of one job under the shared checkpoint folder.

    Saving cuts the lineage: a lost executor costs the tasks of one step, not the job. The
    shuffle files of a step go when its table is complete, so a job holds the largest step
    on disk and not their sum.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = work_folder(spark)
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        conf = self.spark.conf
        before = conf.get(FREE_SHUFFLES, None)
        conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                conf.unset(FREE_SHUFFLES)
            else:
                conf.set(FREE_SHUFFLES, before)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(saved)] = path
        return saved

    def drop(self, *saved: DataFrame) -> None:
        """Removes tables that no result reads any more."""
        for df in saved:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str = "text"):
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, one value of each column at a time, never all texts as Python objects."""
    columns = batch.columns
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` bytes of text (one row at least), so that what a step
    makes of a piece stays small beside the batch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Memo(dict):
    """Values by key, computed once by `make`; forgotten together at `limit` entries."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def longs(values) -> pa.Array:
    """64-bit patterns as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))

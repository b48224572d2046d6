"""A log of stream batches that is folded now and then and survives repeated batches.

Layout below the log's folder: `changes/batch=n` holds what batch n brought, `folds/upto=n` all
batches up to n in one table, and `manifest/n` names the fold and the batches that are the state
after batch n. The manifest is renamed into place when its tables are complete.

Spark repeats a batch whose commit was lost. The repeated batch n starts from manifest n - 1, so
that manifest and its tables stay until batch n + 1 is at work, which shows that n was committed:
two generations are there at any time, and nothing is removed that a repetition could need.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class BatchLog:
    """`latest` reduces rows with their `batch` number to the current ones."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: StructType,
        latest: Callable[[DataFrame], DataFrame],
        fold: int,
    ):
        self.spark, self.folder, self.schema, self.latest, self.fold = spark, folder, schema, latest, fold
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def append(self, changed: DataFrame, number: int) -> None:
        """Takes in batch `number`; may be called again for the newest batch."""
        state = self._manifest(number - 1) if number else {"fold": None, "batches": []}
        changed.write.mode("overwrite").parquet(self._changes(number))
        state["batches"].append(number)
        if len(state["batches"]) >= self.fold:
            folded = self.latest(self._table(state)).withColumn("batch", F.lit(number).cast("long"))
            folded.write.mode("overwrite").parquet(self._folded(number))
            state = {"fold": number, "batches": []}
        self._publish(number, state)
        self._clear(number)

    def current(self) -> DataFrame:
        """The current rows; none before the first batch."""
        numbers = self._numbers("manifest", "")
        state = self._manifest(max(numbers)) if numbers else {"fold": None, "batches": []}
        return self.latest(self._table(state))

    def _changes(self, number: int) -> str:
        return f"{self.folder}/changes/batch={number}"

    def _folded(self, number: int) -> str:
        return f"{self.folder}/folds/upto={number}"

    def _table(self, state: dict) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("batch", LongType())])
        parts = [] if state["fold"] is None else [self.spark.read.schema(schema).parquet(self._folded(state["fold"]))]
        if state["batches"]:
            # The number is read from the folder names, one read for all of them.
            reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/changes")
            parts.append(reader.parquet(*map(self._changes, state["batches"])))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _numbers(self, kind: str, prefix: str) -> list[int]:
        root = self.path(f"{self.folder}/{kind}")
        names = [s.getPath().getName() for s in self.files.listStatus(root)] if self.files.exists(root) else []
        return [int(n.removeprefix(prefix)) for n in names if n.removeprefix(prefix).isdigit()]

    def _manifest(self, number: int) -> dict:
        place = self.path(f"{self.folder}/manifest/{number}")
        if not self.files.exists(place):
            raise ValueError(f"{place} is missing: the log and the stream's progress do not belong together")
        stream = self.files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, state: dict) -> None:
        place, draft = (self.path(f"{self.folder}/manifest/{n}") for n in (number, f"_{number}"))
        stream = self.files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        # Only a repeated batch finds its manifest; should the job end here, it is repeated once more.
        self.files.delete(place, False)
        if not self.files.rename(draft, place):
            raise OSError(f"cannot publish {place}")

    def _clear(self, number: int) -> None:
        """Removes what neither this batch's state nor the one before names."""
        states = [self._manifest(n) for n in (number - 1, number) if n >= 0]
        for n in self._numbers("manifest", ""):
            if n < number - 1:
                self.files.delete(self.path(f"{self.folder}/manifest/{n}"), False)
        batches = {n for s in states for n in s["batches"]} | {number}
        for n in set(self._numbers("changes", "batch=")) - batches:
            self.files.delete(self.path(self._changes(n)), True)
        for n in set(self._numbers("folds", "upto=")) - {s["fold"] for s in states}:
            self.files.delete(self.path(self._folded(n)), True)

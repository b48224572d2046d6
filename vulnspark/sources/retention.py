"""Deleting scans from a stored findings table by rewriting only the files that hold them.

A swap lives in a hidden folder of the table, `_swap-*`: the rewritten files under `new`, and then
`commit`, which names the files they replace. The swap has happened once `commit` is there, because
readers of `read_current` then take the new files for the old ones. Moving and deleting files comes
after that and can be repeated at any time, so a job lost at any point loses and doubles nothing.

One job at a time may change a table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.sources.findings import FINDINGS_ORDER, SCANS_ORDER, clustered

SWAP, COMMIT = "_swap-", "commit"


class _Folder:
    """The table's folder through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def listed(self, folder: str) -> list[str]:
        place = self.path(folder)
        return [s.getPath().getName() for s in self.files.listStatus(place)] if self.files.exists(place) else []

    def data(self, folder: str) -> list[str]:
        return [n for n in self.listed(folder) if n[0] not in "._"]

    def swaps(self) -> list[str]:
        return [f"{self.root}/{n}" for n in self.listed(self.root) if n.startswith(SWAP)]

    def replaced(self, swap: str) -> list[str] | None:
        """Names of the files a swap replaces; none for one that has not happened."""
        place = self.path(f"{swap}/{COMMIT}")
        if not self.files.exists(place):
            return None
        stream = self.files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, swap: str, names: list[str]) -> None:
        draft = self.path(f"{swap}/_{COMMIT}")
        stream = self.files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(names).encode()))
        finally:
            stream.close()
        if not self.files.rename(draft, self.path(f"{swap}/{COMMIT}")):
            raise OSError(f"cannot commit {swap}")

    def remove(self, path: str) -> None:
        self.files.delete(self.path(path), True)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last swap, whether or not that swap's files are in their places yet."""
    folder = _Folder(spark, path)
    gone, files = set(), {}
    for swap in folder.swaps():
        names = folder.replaced(swap)
        if names is not None:
            gone.update(names)
            files.update({n: f"{swap}/new/{n}" for n in folder.data(f"{swap}/new")})
    if not gone:
        return spark.read.parquet(path)
    files.update({n: f"{folder.root}/{n}" for n in folder.data(folder.root) if n not in gone})
    return spark.read.parquet(*files.values())


def finish_swaps(spark: SparkSession, path: str) -> None:
    """Brings the files of finished swaps to their places and removes what unfinished ones left."""
    folder = _Folder(spark, path)
    for swap in folder.swaps():
        names = folder.replaced(swap)
        if names is not None:
            for name in folder.data(f"{swap}/new"):
                # A name is new in every swap, so one that is already there was moved before.
                if not folder.files.rename(folder.path(f"{swap}/new/{name}"), folder.path(f"{folder.root}/{name}")):
                    raise OSError(f"cannot move {swap}/new/{name}")
            for name in names:
                folder.remove(f"{folder.root}/{name}")
        folder.remove(swap)


def files_with(table: DataFrame, gone: DataFrame, key: str) -> list[str]:
    """Names of the table's files that hold one of the keys `gone`.

    Only the key column is read. The least and the greatest key go to the Parquet reader as filters,
    so files whose statistics lie outside are not read at all.
    """
    low, high = gone.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    named = table.select(key, F.col("_metadata.file_name").alias("name"))
    near = named.filter(F.col(key).between(low, high)).join(gone, key, "left_semi")
    return sorted(r.name for r in near.select("name").distinct().collect())


def delete_keys(spark: SparkSession, path: str, keys: DataFrame, key: str, order: tuple[str, ...]) -> list[str]:
    """Removes the rows whose `key` is among `keys` from a table clustered by `order`, of which `key`
    is the first column; returns the names of the replaced files.

    Few files hold a deleted key then; the others keep their names and bytes. The rewritten rows are
    clustered as before. Rows of a null key stay.
    """
    finish_swaps(spark, path)
    table = spark.read.parquet(path)
    gone = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    names = files_with(table, gone, key)
    if not names:
        return []
    folder, swap = _Folder(spark, path), f"{path.rstrip('/')}/{SWAP}{uuid.uuid4().hex}"
    old = spark.read.schema(table.schema).parquet(*(f"{folder.root}/{n}" for n in names))
    kept = old.join(gone, key, "left_anti").select(*table.columns)
    clustered(kept, len(names), order).write.parquet(f"{swap}/new")
    folder.commit(swap, names)
    finish_swaps(spark, path)
    return names


def delete_scans(spark: SparkSession, findings_path: str, deletions: DataFrame, scans_path: str | None = None) -> list[str]:
    """Removes deleted scans (`scan_id`) with all their findings from tables written by `clustered`.

    Findings go first: a job lost in between leaves scans without findings, never findings without a
    scan, and the next run of the same deletions ends the work. Returns the replaced files of findings.
    """
    replaced = delete_keys(spark, findings_path, deletions, "scan_id", FINDINGS_ORDER)
    if scans_path is not None:
        delete_keys(spark, scans_path, deletions.select(F.col("scan_id").alias("id")), "id", SCANS_ORDER)
    return replaced

"""Source archives: list members, judge safety, select and read files."""

from __future__ import annotations

import io
import lzma
import stat
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vulnspark import schemas
from vulnspark.functions import paths
from vulnspark.operators.arrow import PIECE_BYTES, pieces

MIB = 1024 * 1024
#: What a row costs besides its file.
ROW_BYTES = 500


@dataclass(frozen=True)
class Limits:
    """Default archive limits."""

    upload_bytes: int = 50 * MIB
    uncompressed_bytes: int = 500 * MIB
    members: int = 20_000
    compression_ratio: float = 100.0
    file_bytes: int = 2 * MIB


def read_archives(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(archive, upload_bytes, content); bytes over the upload limit are never loaded."""
    files = spark.read.format("binaryFile").load(path)
    name, size = F.col("path").alias("archive"), F.col("length").alias("upload_bytes")
    small = files.filter(F.col("length") <= limits.upload_bytes).select(name, size, "content")
    large = files.filter(F.col("length") > limits.upload_bytes).select(name, size)
    return small.unionByName(large.withColumn("content", F.lit(None).cast("binary")))


def _open(blob: bytes):
    """An opened zip or tar and its format, or (None, None)."""
    buffer = io.BytesIO(blob)
    if zipfile.is_zipfile(buffer):
        return "zip", zipfile.ZipFile(buffer)
    buffer.seek(0)
    try:
        return "tar", tarfile.open(fileobj=buffer)
    except (tarfile.TarError, EOFError):
        return None, None


def _zip_kind(info: zipfile.ZipInfo) -> str:
    if stat.S_ISLNK(info.external_attr >> 16):
        return "link"
    return "dir" if info.is_dir() else "file"


def _tar_kind(info: tarfile.TarInfo) -> str:
    if info.issym() or info.islnk():
        return "link"
    return "file" if info.isfile() else "dir" if info.isdir() else "other"


# What the readers raise on damaged, encrypted or unknown content; such an archive is refused, the
# others go on.
_UNREADABLE = (
    zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError,
    NotImplementedError, KeyError, ValueError, struct.error,
)
_MEMBER = pa.struct(
    [("member_index", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("compressed", pa.int64())]
)


def _headers(blob: bytes | None) -> tuple[str | None, list[tuple]]:
    """Format and (name, kind, size, compressed) of each member, from headers alone."""
    if blob is None:
        return None, []
    try:
        kind, archive = _open(blob)
        if kind == "zip":
            return kind, [(i.filename, _zip_kind(i), i.file_size, i.compress_size) for i in archive.infolist()]
        if kind == "tar":
            return kind, [(m.name, _tar_kind(m), m.size, m.size) for m in archive.getmembers()]
    except _UNREADABLE:
        return "broken", []
    return None, []


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for whole in batches for p in pieces(whole)):
        formats, members = [], []
        for blob in batch.column("content"):
            fmt, found = _headers(blob.as_py())
            formats.append(fmt)
            members.append([dict(zip([f.name for f in _MEMBER], (i, *m), strict=True)) for i, m in enumerate(found)])
        columns = [*batch.columns, pa.array(formats, pa.string()), pa.array(members, pa.list_(_MEMBER))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "format", "members"])


def listed_archives(archives: DataFrame) -> DataFrame:
    """Adds `format` and `members`, the array of each archive's headers, in its own row."""
    schema = (
        f"{schemas.ARCHIVES}, format string, "
        "members array<struct<member_index:int,name:string,kind:string,size:bigint,compressed:bigint>>"
    )
    return archives.select("archive", "upload_bytes", "content").mapInArrow(_list_members, schema)


def archive_members(archives: DataFrame) -> DataFrame:
    """One row per member, by reading headers where the archive's bytes are; at least one row per
    archive, so that empty and unreadable ones are judged."""
    columns = [c.split()[0] for c in schemas.ARCHIVE_MEMBERS.split(", ")]
    rows = listed_archives(archives).select("archive", "format", "upload_bytes", F.explode_outer("members").alias("m"))
    return rows.select("archive", "format", "upload_bytes", "m.*").select(*columns)


def _fault(name: Column, kind: Column, fmt: Column) -> Column:
    """Why one member sinks its archive; null for a harmless one."""
    return (
        F.when(name.isNull(), None)
        .when(~paths.is_safe_member(name), "unsafe_path")
        .when(kind == "link", "link")
        .when((fmt == "tar") & (kind == "other"), "unsupported_member")
    )


def _skipped(name: Column, kind: Column, size: Column, limits: Limits) -> Column:
    """Why a Python file is left out of the selection; null for a selected one and for other members."""
    return F.when(
        (kind == "file") & paths.is_python_file(name),
        F.when(paths.in_skipped_directory(name), "skipped_folder").when(size > limits.file_bytes, "file_too_large"),
    )


def _is_source(name: Column, kind: Column, size: Column, limits: Limits) -> Column:
    return (
        (kind == "file")
        & paths.is_python_file(name)
        & ~paths.in_skipped_directory(name)
        & (size <= limits.file_bytes)
    )


def _reason(total: Callable[[str], Column], limits: Limits) -> Column:
    """The first reason to refuse an archive of these totals, if any."""
    ratio = F.try_divide(total("uncompressed"), total("compressed"))
    # File sizes are never negative, so the running total passes the cap exactly when the
    # whole total does.
    return (
        F.when(total("upload_bytes") > limits.upload_bytes, "upload_too_large")
        .when(total("format").isNull(), "unsupported_format")
        .when(total("format") == "broken", "unreadable")
        .when(total("members") > limits.members, "too_many_members")
        .when(total("fault").isNotNull(), total("fault"))
        .when(total("uncompressed") > limits.uncompressed_bytes, "too_large")
        .when((total("format") == "zip") & (ratio > limits.compression_ratio), "compression_ratio")
        .when(total("python_bytes") > limits.uncompressed_bytes, "selection_too_large")
        .when(total("python_files") == 0, "no_python_files")
    )


def archive_verdicts(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per archive with its counts and the first reason to refuse it, if any.

    Only sums, counts and a first-by-index minimum: every one combines before the shuffle.
    """
    name, kind, size = F.col("name"), F.col("kind"), F.col("size")
    reason = _fault(name, kind, F.col("format"))
    fault = F.when(reason.isNotNull(), F.struct("member_index", reason.alias("reason")))
    source_bytes = F.when(_is_source(name, kind, size, limits), size)
    totals = members.groupBy("archive").agg(
        F.max("format").alias("format"),
        F.max("upload_bytes").alias("upload_bytes"),
        F.count("name").alias("members"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("uncompressed"),
        F.coalesce(F.sum("compressed"), F.lit(0)).alias("compressed"),
        F.count(source_bytes).alias("python_files"),
        F.coalesce(F.sum(source_bytes), F.lit(0)).alias("python_bytes"),
        F.min(fault)["reason"].alias("fault"),
    )
    return totals.withColumn("reason", _reason(F.col, limits)).drop("fault")


def judged_archives(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Listed archives with `reason`, `wanted` (names to read) and `skipped` (name, reason) of the
    Python files left out. The same rules as `archive_verdicts`, over the array of one row, so
    that the archive's bytes stay where they are."""
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    sizes = lambda field: F.transform("members", lambda m: m[field])
    sources = F.filter("members", lambda m: _is_source(m["name"], m["kind"], m["size"], limits))
    faults = F.transform("members", lambda m: _fault(m["name"], m["kind"], F.col("format")))
    left_out = F.transform(
        "members", lambda m: F.struct(m["name"].alias("name"), _skipped(m["name"], m["kind"], m["size"], limits).alias("reason"))
    )
    totals = {
        "format": F.col("format"),
        "upload_bytes": F.col("upload_bytes"),
        "members": F.size("members"),
        "uncompressed": total(sizes("size")),
        "compressed": total(sizes("compressed")),
        "python_files": F.size(sources),
        "python_bytes": total(F.transform(sources, lambda m: m["size"])),
        "fault": F.get(F.filter(faults, lambda f: f.isNotNull()), F.lit(0)),
    }
    listed = listed_archives(archives).withColumn("reason", _reason(totals.__getitem__, limits))
    accepted = F.col("reason").isNull()
    return listed.withColumns(
        {
            "wanted": F.when(accepted, F.array_distinct(F.transform(sources, lambda m: m["name"]))),
            "skipped": F.when(accepted, F.filter(left_out, lambda m: m["reason"].isNotNull())),
        }
    )


def select_sources(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Python files of accepted archives with their running size in path order.

    An accepted archive has at most `limits.members` members, which bounds each window.
    """
    accepted = archive_verdicts(members, limits).filter("reason is null").select("archive")
    by_path = W.partitionBy("archive").orderBy(paths.parts(F.col("name")), "member_index")
    return (
        members.filter(_is_source(F.col("name"), F.col("kind"), F.col("size"), limits))
        .join(accepted, "archive", "left_semi")
        .select("archive", "name", "size", "member_index")
        .withColumn("running_bytes", F.sum("size").over(by_path))
    )


def mining_files(files: DataFrame, path: str = "name") -> DataFrame:
    """Files worth mining: `.py`, and not below a test, doc or vendored folder."""
    return files.filter(paths.is_mining_file(F.col(path)))


def _members_of(archive: str, blob: bytes | None, reason: str | None, wanted: list | None, skipped: list | None) -> list[tuple]:
    """(archive, file_path, raw, reason) of everything one archive gives or leaves out."""
    if reason:
        return [(archive, None, None, reason)]
    rows = [(archive, m["name"], None, m["reason"]) for m in skipped]
    try:
        fmt, opened = _open(blob)
        for name in wanted:
            raw = opened.read(name) if fmt == "zip" else opened.extractfile(name).read()
            rows.append((archive, name, raw, None))
    except _UNREADABLE:
        return [(archive, None, None, "unreadable")]
    return rows


_READ = pa.schema([("archive", pa.string()), ("file_path", pa.string()), ("raw", pa.binary()), ("reason", pa.string())])


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch per so many bytes read, not one per archive: a batch of few rows costs as much as one of many."""
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ, strict=True)], schema=_READ)
    rows, held = [], 0
    for piece in (p for batch in batches for p in pieces(batch)):
        for values in zip(*piece.columns, strict=True):
            found = _members_of(*(v.as_py() for v in values))
            rows += found
            held += ROW_BYTES * len(found) + sum(len(raw) for _, _, raw, _ in found if raw)
            if held > PIECE_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
    if rows:
        yield batch_of(rows)


def read_members(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, file_path, content, reason): every selected file with its text, and everything that
    is left out with the reason: an archive (null path) or one file of it. An archive with a
    member that cannot be read is refused as a whole. One listing and one reading step, row by
    row; no shuffle."""
    raw = (
        judged_archives(archives, limits)
        .select("archive", "content", "reason", "wanted", "skipped")
        .mapInArrow(_read_members, "archive string, file_path string, raw binary, reason string")
    )
    text = F.try_validate_utf8(F.col("raw").cast("string"))
    unread = F.when(F.col("raw").isNotNull() & text.isNull(), "not_utf8")
    return raw.select("archive", "file_path", text.alias("content"), F.coalesce("reason", unread).alias("reason"))


def read_sources(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, file_path, content) of every selected file that is valid UTF-8."""
    return read_members(archives, limits).filter("reason IS NULL").drop("reason")


def skipped_files(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, file_path, reason) of all that `read_sources` leaves out; a whole archive has no path."""
    return read_members(archives, limits).filter("reason IS NOT NULL").drop("content")


def decode_text(files: DataFrame) -> DataFrame:
    """Bytes in `raw` become text in `content`; files that are not UTF-8 are left out."""
    return (
        files.withColumn("content", F.try_validate_utf8(F.col("raw").cast("string")))
        .filter(F.col("content").isNotNull())
        .drop("raw")
    )

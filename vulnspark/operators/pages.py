"""Deep pages of long lists: rows stored in their order, and a table of where each list starts.

Paging by offset sorts all rows before the page in one task. Here the rows are sorted once, in
ranges that split a long list over many files; a row's number inside its range is stored with it. The
starts say which places of a list each range holds, so a page at any depth reads the one or two files
and the row groups that hold its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a row's number inside its range, as `monotonically_increasing_id` lays them out.
ROW_BITS = 33


def write_pages(rows: DataFrame, folder: str, lists: str, order: list[Column]) -> None:
    """Stores `rows` for `read_page`: lists by the column `lists`, each in the given total order."""
    keys = [F.col(lists), *order]
    number = F.monotonically_increasing_id()
    numbered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(
        {"_range": F.shiftright(number, ROW_BITS), "_row": number.bitwiseAND(F.lit((1 << ROW_BITS) - 1))}
    )
    numbered.write.parquet(f"{folder}/rows")
    stored = rows.sparkSession.read.parquet(f"{folder}/rows")
    ranges = stored.groupBy(lists, "_range").agg(F.min("_row").alias("first"), F.count("*").alias("n"))
    # A row for each range that holds part of a list: few per list, unlike the rows themselves.
    before = W.partitionBy(lists).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn("place", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts.repartitionByRange(lists, "place").sortWithinPartitions(lists, "place").write.parquet(f"{folder}/starts")


def read_page(spark: SparkSession, folder: str, lists: str, value, limit: int, offset: int) -> DataFrame:
    """Rows `offset` up to `offset + limit` of one list, with their `place` in it.

    The list's starts are looked up first; what they name is read with filters on range and row
    number that reach the Parquet statistics."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    stored = spark.read.parquet(f"{folder}/rows")
    starts = spark.read.parquet(f"{folder}/starts").filter(F.col(lists).eqNullSafe(F.lit(value)))
    touched = starts.filter((F.col("place") < offset + limit) & (F.col("place") + F.col("n") > offset)).collect()
    inside, place = F.lit(False), F.lit(None).cast("long")
    for s in touched:  # as many as the page overlaps: one or two, unless it is longer than a range
        low, high = s.first + max(offset - s.place, 0), s.first + min(offset + limit - s.place, s.n) - 1
        here = (F.col("_range") == s["_range"]) & F.col("_row").between(low, high)
        inside = inside | here
        place = F.when(here, F.col("_row") - s.first + s.place).otherwise(place)
    page = stored.filter(inside).withColumn("place", place)
    return page.drop("_range", "_row").orderBy("place")

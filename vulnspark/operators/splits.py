"""Repository-disjoint splits and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnspark.taxonomy import LABELS, label_dim

DEFAULT_SALT = "vulnspark-v1"
SETS = ("train", "validation", "test_full", "test_real")


def repo_bucket(repository_id: Column, salt: str = DEFAULT_SALT) -> Column:
    """Stable number in [0, 1): the first 8 bytes of SHA-256(salt:repository) over 2^64."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), repository_id), 256)
    high = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return high.cast("double") / F.lit(float(2**64))


def make_splits(
    records: DataFrame,
    val_frac: float = 0.10,
    test_frac: float = 0.15,
    salt: str = DEFAULT_SALT,
) -> DataFrame:
    """Adds `split` and `in_test_real`. A projection: nothing moves, and a record's split
    depends on its repository alone, so new data never reshuffles old."""
    bucket = repo_bucket(F.col("repository_id"), salt)
    split = (
        F.when(bucket < test_frac, "test_full")
        .when(bucket < test_frac + val_frac, "validation")
        .otherwise("train")
    )
    real = ~F.col("is_synthetic") & (F.col("source") == "mined")
    return records.withColumn("split", split).withColumn(
        "in_test_real", (F.col("split") == "test_full") & real
    )


def long_form(split_records: DataFrame) -> DataFrame:
    """One row per (record, set): real test records count in both test sets."""
    sets = F.when(F.col("in_test_real"), F.array(F.lit("test_full"), F.lit("test_real")))
    return split_records.withColumn(
        "set_name", F.explode(F.coalesce(sets, F.array(F.col("split"))))
    )


def split_summary(split_records: DataFrame) -> DataFrame:
    """Rows, synthetic rows and rows per class of each of the four sets."""
    per_label = [F.count_if(F.col("vulnerability_type") == n).alias(f"n_{n}") for n in LABELS]
    return (
        long_form(split_records)
        .groupBy("set_name")
        .agg(
            F.count("*").alias("n"), F.count_if("is_synthetic").alias("n_synthetic"), *per_label
        )
    )


def straddling_repositories(split_records: DataFrame) -> DataFrame:
    """Repositories found in more than one split, with each of the splits."""
    return (
        split_records.groupBy("repository_id")
        .agg(F.count_distinct("split").alias("n_splits"))
        .filter("n_splits > 1")
    )


def split_overlap(split_records: DataFrame) -> DataFrame:
    """For each pair of splits, how many repositories they share (all zero when sound)."""
    pairs = (("train", "validation"), ("train", "test_full"), ("validation", "test_full"))
    flags = [F.bool_or(F.col("split") == s).alias(s) for s in SETS[:3]]
    shared = split_records.groupBy("repository_id").agg(*flags)
    counts = shared.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}-{b}") for a, b in pairs])
    return counts.unpivot([], [f"{a}-{b}" for a, b in pairs], "pair", "shared_repositories")


#: Bits of a sketch's registers; the relative standard error is 1.04 / 2^(bits / 2).
SKETCH_BITS = 12


def repository_sketches(split_records: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(split, sketch): a HyperLogLog sketch of each split's repositories.

    A sketch is a few kilobytes whatever it saw. Sketches of batches are stored with the corpus and
    united on append (`united_sketches`), so counting repositories does not read the corpus again."""
    return split_records.groupBy("split").agg(F.hll_sketch_agg("repository_id", F.lit(bits)).alias("sketch"))


def united_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch per split from those of any number of batches."""
    return sketches.groupBy("split").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_repositories(sketches: DataFrame) -> DataFrame:
    """(split, n_repositories), estimated."""
    return sketches.select("split", F.hll_sketch_estimate("sketch").alias("n_repositories"))


def sketch_error(bits: int = SKETCH_BITS, deviations: float = 4.0) -> float:
    """The relative error that `deviations` standard errors allow."""
    return deviations * 1.04 / 2 ** (bits / 2)


def corpus_stats(split_records: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(metric, key, n) build statistics, from one pass of grouping sets."""
    grouped = split_records.groupingSets(
        [
            [],
            [F.col("vulnerability_type")],
            [F.col("source")],
            [F.col("split")],
        ],
        F.col("vulnerability_type"),
        F.col("source"),
        F.col("split"),
    ).agg(
        F.count("*").alias("n"),
        F.count_if("is_synthetic").alias("n_synthetic"),
        F.count_if(~F.col("is_synthetic")).alias("n_real"),
        F.count_if("in_test_real").alias("n_test_real"),
        F.count_distinct("repository_id").alias("n_repositories"),
        F.grouping_id().alias("gid"),
    )

    def entry(metric: str, key: Column, n: str) -> Column:
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"), F.col(n).alias("n"))

    # Bits of the grouping id, high to low: label, source, split; a set bit means "rolled up".
    whole, label, source, split = 0b111, 0b011, 0b101, 0b110
    none = F.lit("")
    entries = (
        F.when(
            F.col("gid") == whole,
            F.array(
                entry("total", none, "n"),
                entry("synthetic", none, "n_synthetic"),
                entry("real", none, "n_real"),
                entry("repositories", none, "n_repositories"),
                entry("splits", F.lit("test_real"), "n_test_real"),
            ),
        )
        .when(
            F.col("gid") == label,
            F.array(
                entry("by_label", F.col("vulnerability_type"), "n"),
                entry("by_label_real_only", F.col("vulnerability_type"), "n_real"),
            ),
        )
        .when(F.col("gid") == source, F.array(entry("by_source", F.col("source"), "n")))
        .when(F.col("gid") == split, F.array(entry("splits", F.col("split"), "n")))
    )
    stats = grouped.select(F.inline(entries))
    if dropped is not None:
        count = dropped.agg(F.count("*").alias("n"))
        stats = stats.unionByName(
            count.select(F.lit("duplicates_dropped").alias("metric"), none.alias("key"), "n")
        )
    return stats


def class_weights(records: DataFrame) -> DataFrame:
    """Inverse-frequency weight per class, scaled so that present classes average 1."""
    counts = records.groupBy(F.col("vulnerability_type").alias("label")).agg(
        F.count("*").alias("n")
    )
    dense = label_dim(records.sparkSession).select("label_id", "label").join(counts, "label", "left")
    # Windows over the seven class rows.
    every = W.partitionBy(F.lit(0))
    n = F.coalesce("n", F.lit(0))
    raw = F.when(n > 0, F.sum(n).over(every) / (len(LABELS) * n)).otherwise(0.0)
    mean = F.avg(F.when(F.col("raw") > 0, F.col("raw"))).over(every)
    return dense.withColumn("raw", raw).select(
        "label_id", "label", n.alias("n"), (F.col("raw") / F.coalesce(mean, F.lit(1.0))).alias("weight")
    )


def synthetic_share(split_records: DataFrame, warn_over: float = 0.8) -> DataFrame:
    """Synthetic share per split, flagged where it is too high to trust a fit."""
    share = F.avg(F.col("is_synthetic").cast("double"))
    return (
        split_records.groupBy("split")
        .agg(F.count("*").alias("n"), share.alias("synthetic_share"))
        .withColumn("warn", F.col("synthetic_share") > warn_over)
    )


def fit_pool(validation: DataFrame, at_least: int = 50) -> DataFrame:
    """Real validation rows when there are enough of them, else every row."""
    real = validation.agg(F.count_if(~F.col("is_synthetic"))).scalar()
    return validation.filter((real < at_least) | ~F.col("is_synthetic"))

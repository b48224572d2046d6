"""The corpus build: union, near-duplicate removal, split, store, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vulnspark.operators.dedup import deduplicate
from vulnspark.operators.splits import DEFAULT_SALT, corpus_stats, make_splits
from vulnspark.sources.corpus import union_corpora, valid_records, with_violation, write_splits


def build_corpus(
    corpora: list[DataFrame],
    path: str,
    id_col: str,
    salt: str = DEFAULT_SALT,
    quarantine: str | None = None,
    **dedup_options,
) -> DataFrame:
    """Writes the split corpus under `path` and returns its statistics.

    Removal comes before the split, so near-twins never stand on both sides of it. A record that
    breaks an invariant ends the job, or goes with its violation to the table `quarantine`.
    """
    everything = union_corpora(*corpora)
    if quarantine:
        with_violation(everything).filter("violation IS NOT NULL").write.parquet(quarantine)
    records = valid_records(everything, strict=not quarantine)
    kept, dropped = deduplicate(records, id_col, **dedup_options)
    write_splits(make_splits(kept, salt=salt), f"{path}/records")
    stored = records.sparkSession.read.parquet(f"{path}/records")
    return corpus_stats(stored, dropped)

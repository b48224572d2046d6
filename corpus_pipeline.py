"""A training corpus from raw documents: rejected, copied, near-copied and leaked documents leave,
the rest is packed into token sequences.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept and returns the
columns of documents, but the last: that one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vulnspark.llm.common import Store, documents
from vulnspark.llm.decontamination import remove_contaminated
from vulnspark.llm.exact_dedup import remove_copies
from vulnspark.llm.ngram_join import keep_first_of_components
from vulnspark.llm.packing import pack
from vulnspark.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents scored as toxic; the model learns from the labelled ones among `docs`."""
    return remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return remove_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the one with the smallest id stays."""
    return keep_first_of_components(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a test item."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Store(spark), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

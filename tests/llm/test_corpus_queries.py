"""Registered queries of the subpackage against SQL, and the pipeline against its parts by brute force."""

from __future__ import annotations

import sys

import duckdb
import public_tokenizers
import pytest
from conftest import SMALL

sys.path.insert(0, "tools")

from check import TABLES, normal  # noqa: E402

import __spark_entry__ as driver  # noqa: E402
import corpus_pipeline  # noqa: E402
from vulnspark.llm import decontamination, toxicity  # noqa: E402
from vulnspark.llm.packing import Ids  # noqa: E402
from vulnspark.llm.queries import ORACLES, QUERIES  # noqa: E402


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cur = duck.execute(ORACLES[name])
    assert normal(df.columns, df.collect()) == normal([d[0] for d in cur.description], cur.fetchall())


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    scored = toxicity.toxicity(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    left = sorted(r.doc_id for r in scored.collect() if r.predicted == 0)
    last = {docs[i]: i for i in left}  # of equal texts the largest id
    left = sorted(last.values())
    sets, root = {i: shingles(docs[i]) for i in left}, {i: i for i in left}
    for b in left:
        for a in left:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    left = [i for i in left if root[i] == i]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    index = decontamination.Index([(r.item_id, r.text) for r in items])
    left = [i for i in left if not index.matches(docs[i], decontamination.THRESHOLD, decontamination.OVERLAP)]
    ids = Ids(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(ids(docs[i])) // 4 + 1 for i in left}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(left) and 0 < len(left) < len(docs)
    total: dict[int, int] = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == lengths


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0

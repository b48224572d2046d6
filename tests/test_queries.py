"""Every registered query against its SQL oracle, and streams against batches."""

from __future__ import annotations

import sys

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

sys.path.insert(0, "tools")

from check import KIND, TABLES, normal  # noqa: E402

import __spark_entry__ as driver  # noqa: E402
from vulnspark.operators import dashboard  # noqa: E402
from vulnspark.plans import inputs  # noqa: E402
from vulnspark.plans.oracles import ORACLES  # noqa: E402
from vulnspark.plans.queries import QUERIES  # noqa: E402
from vulnspark.session import work_folder  # noqa: E402
from vulnspark.streaming import jobs  # noqa: E402

# Checked by rows only: no SQL replays the default 128 hashes or a forest.
ROWS_ONLY = {"dedup_kept_fast", "dedup_kept_full", "rf_baseline", "rf_labels"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = driver.queries()[name](spark, SMALL)
    sql = driver.oracle_sql()[name]
    kinds = {r[0]: KIND.get(r[1], r[1]) for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert kinds == dict(df.dtypes)
    cur = duck.execute(sql)
    columns = [d[0] for d in cur.description]
    assert normal(df.columns, df.collect()) == normal(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_query_runs(spark, name):
    assert driver.queries()[name](spark, SMALL).count() > 0


def test_removal_keeps_one_of_each_group(spark):
    kept = driver.queries()["dedup_kept_full"](spark, SMALL)
    docs = inputs.documents(spark, SMALL)
    left = docs.join(kept, "doc_id")
    assert left.count() == left.select("text").distinct().count()
    assert left.select("text").distinct().count() <= docs.select("text").distinct().count()


def test_stream_in_several_batches_equals_batch(spark, folder):
    found = inputs.findings(spark, SMALL)
    found.repartition(6).write.parquet(f"{folder}/in")
    arriving = lambda: jobs.read_stream(spark, f"{folder}/in", found.schema, max_files=1)
    keys = list(dashboard.FINDING_LOCATION)
    unique = jobs.stream_dedup(arriving(), work_folder(spark))
    assert unique.count() == found.select(keys).distinct().count() == unique.select(keys).distinct().count()
    batch = dashboard.summary_by_severity(found)
    # With the log folded after every second batch, and never.
    for fold in (2, 50):
        live = jobs.stream_summary(arriving(), work_folder(spark), fold)
        assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.select(live.columns).collect()))


def test_watermarked_dedup_and_restart(spark, folder):
    found = inputs.findings(spark, SMALL).withColumn("created_at", F.col("created_at").cast("timestamp"))
    half = found.filter("start_line % 2 = 0")
    half.coalesce(1).write.parquet(f"{folder}/in")
    out = work_folder(spark)
    first = jobs.stream_dedup(jobs.read_stream(spark, f"{folder}/in", found.schema), out, "3650 days").count()
    found.filter("start_line % 2 = 1").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    # The second run starts from the first one's progress: old files are not read again.
    total = jobs.stream_dedup(jobs.read_stream(spark, f"{folder}/in", found.schema), out, "3650 days").count()
    keys = list(dashboard.FINDING_LOCATION)
    assert first == half.select(keys).distinct().count()
    assert total == found.select(keys).distinct().count()

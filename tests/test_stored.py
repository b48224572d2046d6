"""Tables that jobs change or read in parts: stream logs, deletions, pages, buckets, sketches."""

from __future__ import annotations

import os
import re
import shutil
from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vulnspark.operators import bucketed, dashboard, pages, splits
from vulnspark.plans import inputs
from vulnspark.session import work_folder
from vulnspark.sources import findings, retention
from vulnspark.streaming import jobs
from vulnspark.streaming.log import BatchLog
from vulnspark.streaming.seen import milliseconds

KEYS = list(dashboard.FINDING_LOCATION)


def found(spark):
    return inputs.findings(spark, SMALL).withColumn("created_at", F.col("created_at").cast("timestamp"))


def pieces(df, folder, n):
    """`n` folders of one Parquet file each."""
    for i in range(n):
        df.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i).coalesce(1).write.parquet(f"{folder}/piece{i}")
    return [next(Path(f"{folder}/piece{i}").glob("part-*.parquet")) for i in range(n)]


def arrive(file, folder, i):
    os.makedirs(folder, exist_ok=True)
    shutil.copy(file, f"{folder}/part-{i:03d}.parquet")


def forget_commit(progress):
    """The last batch's commit, as if the driver was lost before it."""
    commits = Path(progress) / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    return last


# --- streams ---


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_counts_survive_a_lost_commit_at_every_batch_of_a_fold(spark, folder):
    files = pieces(found(spark), f"{folder}/all", 7)
    out, schema = f"{folder}/out", found(spark).schema
    arriving = lambda: jobs.read_stream(spark, f"{folder}/in", schema, max_files=1)
    for i, file in enumerate(files):
        arrive(file, f"{folder}/in", i)
        batch = dashboard.summary_by_severity(spark.read.schema(schema).parquet(f"{folder}/in"))
        live = jobs.stream_summary(arriving(), out, fold=3)
        assert rows_of(live) == rows_of(batch.select(live.columns))
        assert forget_commit(f"{out}/counts-progress") == i
        again = jobs.stream_summary(arriving(), out, fold=3)
        assert rows_of(again) == rows_of(batch.select(live.columns))
    # Two generations at most: a fold, what came since, and what the one before needs.
    assert len(list(Path(f"{out}/counts/manifest").glob("[0-9]*"))) == 2
    assert len(list(Path(f"{out}/counts/changes").glob("batch=*"))) <= 4


def test_log_without_its_progress_is_an_error(spark, folder):
    df = spark.createDataFrame([("s", "HIGH", 1)], "scan_id string, severity string, count long")
    log = BatchLog(spark, f"{folder}/log", df.schema, jobs.latest_counts, 3)
    assert log.current().count() == 0
    log.append(df, 0)
    with pytest.raises(ValueError, match="missing"):
        log.append(df, 2)
    log.append(df.withColumn("count", F.lit(5).cast("long")), 1)
    assert rows_of(log.current()) == [("s", "HIGH", 5)]


def test_streams_without_a_file_give_empty_tables(spark, folder):
    os.makedirs(f"{folder}/in")
    arriving = lambda: jobs.read_stream(spark, f"{folder}/in", found(spark).schema)
    assert jobs.stream_summary(arriving(), f"{folder}/a").count() == 0
    assert jobs.stream_dedup(arriving(), f"{folder}/b").count() == 0
    assert jobs.stream_scan(arriving(), lambda df: df.select("id"), f"{folder}/c").columns == ["id"]
    assert jobs.stream_first_of_scan(arriving(), f"{folder}/d", "1 day").count() == 0


def test_state_of_a_finished_scan_goes(spark, folder):
    def day(n, scan, lines):
        rows = [(scan, "f", "g", line, f"2024-01-{n:02d} 00:00:00") for line in lines]
        df = spark.createDataFrame(rows, "scan_id string, file_path string, function_name string, start_line int, at string")
        return df.select(*KEYS, F.col("at").cast("timestamp").alias("created_at"))

    first = [day(1, "old", range(200)), day(2, "old", range(100, 300)), day(3, "new", [1, 1, 2])]
    later = [day(20, "new", [2, 3]), day(21, "new", [4]), day(22, "new", [4, 5])]
    out, schema = f"{folder}/out", first[0].schema

    def state(name):
        reader = spark.read.format("statestore").option("stateVarName", "seen")
        return {r.key.scan_id: r.n for r in reader.load(f"{out}/{name}-progress").groupBy("key").agg(F.count("*").alias("n")).collect()}

    sizes = []
    for i, df in enumerate(first + later):
        df.coalesce(1).write.parquet(f"{folder}/day{i}")
        arrive(next(Path(f"{folder}/day{i}").glob("part-*.parquet")), f"{folder}/in", i)
        unique = jobs.stream_first_of_scan(jobs.read_stream(spark, f"{folder}/in", schema, 1), out, "5 days", slots=1)
        sizes.append(state("first"))
    assert sizes[1] == {"old": 300} and "old" not in sizes[-1] and sizes[-1]["new"] <= 5
    want = {("old", line) for line in range(300)} | {("new", line) for line in (1, 2, 3, 4, 5)}
    got = unique.select("scan_id", "start_line").collect()
    assert {tuple(r) for r in got} == want
    assert sum(r.scan_id == "old" for r in got) == 300


def test_first_of_scan_in_a_session_with_sparks_own_state_store(spark, folder):
    key = "spark.sql.streaming.stateStore.providerClass"
    own = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, own)
    try:
        df = spark.createDataFrame([("s", "f", "g", line, "2024-01-01") for line in (1, 2, 1)], "scan_id string, file_path string, function_name string, start_line int, at string")
        df.select(*KEYS, F.col("at").cast("timestamp").alias("created_at")).write.parquet(f"{folder}/in")
        schema = spark.read.parquet(f"{folder}/in").schema
        unique = jobs.stream_first_of_scan(jobs.read_stream(spark, f"{folder}/in", schema), f"{folder}/out", "5 days")
        assert sorted(r.start_line for r in unique.collect()) == [1, 2]
        assert spark.conf.get(key) == own
    finally:
        spark.conf.set(key, before)


def test_milliseconds():
    assert milliseconds("2 days") == 172_800_000 and milliseconds("1 minute") == 60_000


# --- deletions ---


def table_of(spark, folder):
    path = f"{folder}/findings"
    findings.clustered(inputs.findings(spark, SMALL), 12).write.parquet(path)
    return path


def parts(path):
    return {p.name: p.read_bytes() for p in Path(path).glob("part-*.parquet")}


def test_only_files_of_deleted_scans_are_rewritten(spark, folder):
    path, deleted = table_of(spark, folder), spark.createDataFrame([("s11",), ("s11",), ("s48",), ("nowhere",)], "scan_id string")
    before = parts(path)
    replaced = retention.delete_scans(spark, path, deleted)
    after = parts(path)
    assert 0 < len(replaced) < len(before) and set(before) - set(after) == set(replaced)
    assert all(after[n] == before[n] for n in set(before) - set(replaced))
    kept = dashboard.retain(inputs.findings(spark, SMALL), deleted)
    assert rows_of(retention.read_current(spark, path).select("id")) == rows_of(kept.select("id"))
    assert not list(Path(path).glob("_swap-*"))
    assert retention.delete_scans(spark, path, deleted) == []
    assert retention.delete_scans(spark, path, deleted.limit(0)) == []


def test_files_are_found_from_statistics(spark, folder, capsys):
    path = table_of(spark, folder)
    table = spark.read.parquet(path)
    table.filter(F.col("scan_id").between("s11", "s11")).select("scan_id", "_metadata.file_name").explain("formatted")
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(scan_id,s11\)", capsys.readouterr().out)
    names = retention.files_with(table, spark.createDataFrame([("s11",)], "scan_id string"), "scan_id")
    own = table.filter("scan_id = 's11'").select("_metadata.file_name").distinct().collect()
    assert names == sorted(r.file_name for r in own)


def test_a_deleted_scan_leaves_with_its_findings(spark, folder):
    path, deleted = table_of(spark, folder), spark.createDataFrame([("s11",), (None,), ("s3",)], "scan_id string")
    scans = inputs.scans(spark, SMALL)
    findings.clustered(scans.unionByName(scans.limit(1).withColumn("id", F.lit(None).cast("string"))), 5, ("id",)).write.parquet(f"{folder}/scans")
    before = parts(f"{folder}/scans")
    retention.delete_scans(spark, path, deleted, f"{folder}/scans")
    assert {"s11", "s3"}.isdisjoint(r.scan_id for r in retention.read_current(spark, path).select("scan_id").distinct().collect())
    left = [r.id for r in retention.read_current(spark, f"{folder}/scans").collect()]
    assert sorted(left, key=str) == sorted([*({r.id for r in scans.collect()} - {"s11", "s3"}), None], key=str)
    assert 0 < len(set(before) - set(parts(f"{folder}/scans"))) <= 2


class Lost(Exception):
    pass


@pytest.mark.parametrize("calls", range(12))
def test_a_lost_job_loses_and_doubles_nothing(spark, folder, monkeypatch, calls):
    """The job ends after so many renames, removals and commits; readers and the next job see whole states."""
    path = table_of(spark, folder)
    deleted = spark.createDataFrame([("s11",), ("s30",), ("s48",)], "scan_id string")
    whole = rows_of(spark.read.parquet(path).select("id"))
    kept = rows_of(dashboard.retain(inputs.findings(spark, SMALL), deleted).select("id"))
    left = [calls]

    class Counted:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            target = getattr(self.files, name)

            def call(*args):
                if name in ("rename", "delete", "create"):
                    left[0] -= 1
                    if left[0] < 0:
                        raise Lost
                return target(*args)

            return call

    init = retention._Folder.__init__

    def counted(self, *args):
        init(self, *args)
        self.files = Counted(self.files)

    monkeypatch.setattr(retention._Folder, "__init__", counted)
    try:
        retention.delete_scans(spark, path, deleted)
    except Lost:
        pass
    monkeypatch.undo()
    assert rows_of(retention.read_current(spark, path).select("id")) in (whole, kept)
    retention.delete_scans(spark, path, deleted)
    assert rows_of(spark.read.parquet(path).select("id")) == kept
    assert not list(Path(path).glob("_swap-*"))


# --- pages ---


def test_pages_at_every_depth(spark, folder):
    rows = dashboard.active(inputs.findings(spark, SMALL))
    order = [F.col("confidence").desc(), F.col("id")]
    pages.write_pages(rows.repartition(9), folder, "scan_id", order)
    want = [r.id for r in rows.filter("scan_id = 's10'").orderBy(*order).collect()]
    for offset, limit in ((0, 1), (0, 10_000), (7, 13), (len(want) - 2, 10), (len(want), 5)):
        page = pages.read_page(spark, folder, "scan_id", "s10", limit, offset).collect()
        assert [r.id for r in page] == want[offset : offset + limit]
        assert [r.place for r in page] == list(range(offset, min(offset + limit, len(want))))
    assert pages.read_page(spark, folder, "scan_id", "absent", 5, 0).count() == 0
    with pytest.raises(ValueError):
        pages.read_page(spark, folder, "scan_id", "s10", 0, 0)


def test_a_deep_page_reads_its_rows_only(spark, folder, capsys):
    rows = spark.range(200_000).select(F.lit("one").alias("scan_id"), "id")
    pages.write_pages(rows, folder, "scan_id", [F.col("id").desc()])
    page = pages.read_page(spark, folder, "scan_id", "one", 100, 150_000)
    assert [r.id for r in page.collect()] == list(range(49_999, 49_899, -1))
    page.explain("formatted")
    told = capsys.readouterr().out
    pushed = re.findall(r"PushedFilters: (.*)", told)[0]
    assert "_range" in pushed and "_row" in pushed
    ranges = spark.read.parquet(f"{folder}/rows").groupBy(F.col("_metadata.file_name")).agg(F.countDistinct("_range").alias("n"))
    assert {r.n for r in ranges.collect()} == {1}


# --- buckets ---


def test_stored_dismissals_join_without_an_exchange(spark, folder):
    rows, log = inputs.customer_findings(spark, SMALL), inputs.dismissals(spark, SMALL)
    stored = bucketed.store_findings(rows, "t_findings", f"{folder}/findings", 4)
    bucketed.append_dismissals(log.filter("seq % 3 = 0"), "t_log", f"{folder}/log", 4)
    whole = bucketed.append_dismissals(log.filter("seq % 3 > 0"), "t_log", f"{folder}/log", 4)
    compact = bucketed.compact_dismissals(whole, "t_compact", f"{folder}/compact", 4)
    want = rows_of(dashboard.apply_dismissals(rows, log).select("id", "dismissed"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert compact.count() == log.select("finding_id").distinct().count() and whole.count() == log.count()
        for table in (whole, compact):
            marked = dashboard.apply_dismissals(stored, table)
            assert "Exchange" not in marked._jdf.queryExecution().executedPlan().toString()
            assert rows_of(marked.select("id", "dismissed")) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("t_findings", "t_log", "t_compact"):
            spark.sql(f"DROP TABLE {name}")
    assert log.select("finding_id").distinct().count() < log.count()


# --- sketches ---


def test_sketches_of_batches_count_like_one(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "train").otherwise("test").alias("split"),
        F.concat(F.lit("r"), (F.col("id") % 20_000).cast("string")).alias("repository_id"),
    )
    parts = [splits.repository_sketches(rows.filter(F.col("repository_id").endswith(str(d)))) for d in range(10)]
    stored = parts[0]
    for part in parts[1:]:
        stored = stored.unionByName(part)
    got = {r.split: r.n_repositories for r in splits.estimated_repositories(splits.united_sketches(stored)).collect()}
    exact = {r.split: r.n for r in rows.groupBy("split").agg(F.countDistinct("repository_id").alias("n")).collect()}
    assert all(abs(got[s] - n) <= splits.sketch_error() * n for s, n in exact.items())
    largest = splits.repository_sketches(rows).agg(F.max(F.length("sketch"))).first()[0]
    assert largest < 10_000

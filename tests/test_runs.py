"""Tables of runs: what readers see while runs are repeated and folded, and the index of newest snapshots."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapfolio.operators import responses, store
from snapfolio.sources import landing, newest_index, store_table
from snapfolio.sources.runs import RunTable, _names, _ranges
from snapfolio.sources.scratch import new_folder
from tests.conftest import SF_SMALL
from workloads import fixtures

NUMBERS = "n BIGINT"


def _add(table, run, *numbers, **options):
    folder = table.new_folder()
    table.spark.createDataFrame([(n,) for n in numbers], NUMBERS).coalesce(1).write.parquet(table.folder(folder))
    return table.enter(folder, [run], **options)


def _numbers(table, parts=None):
    return sorted(r["n"] for r in table.read(NUMBERS, parts).collect())


def _fold(table, fan=3):
    table.fold(lambda parts, folder: table.read(NUMBERS, parts).coalesce(1).write.parquet(folder), fan)


@pytest.fixture
def table(spark):
    return RunTable(spark, new_folder(spark, "test-runs"))


def test_ranges():
    names = {"a-0", "a-1", "a-2", "a-7", "b", "b-01", "10", "11", ""}
    assert _names(_ranges(names)) == names
    assert len(_ranges({f"stream-x-{i}" for i in range(10_000)})) == 1


def test_a_run_is_seen_whole_or_not_at_all(table):
    assert _numbers(table) == []
    _add(table, "one", 1, 2)
    before = table.listed()
    table.spark.createDataFrame([(9,)], NUMBERS).write.parquet(table.folder(table.new_folder()))
    assert _numbers(table) == [1, 2]  # a folder that was never entered
    _add(table, "one", 3)
    assert _numbers(table) == [3]
    assert _numbers(table, before.parts) == [1, 2]  # a reader that began before
    assert (before.epoch, table.listed().epoch) == (0, 1)
    assert not _add(table, "one", 4, once=True) and _numbers(table) == [3]


def test_the_second_of_two_writers_sees_the_first(table):
    other = RunTable(table.spark, table.path)
    _add(table, "a", 1)

    def late(now):
        if "b" not in now.runs:
            _add(other, "b", 2)
        return now

    table.change(late)
    assert _numbers(table) == [1, 2] and table.listed().version == 3


def test_folding_keeps_rows_and_bounds_parts(table):
    for i in range(27):
        _add(table, f"r-{i}", i, 100 + i)
        _fold(table)
    listed = table.listed()
    assert _numbers(table) == sorted([*range(27), *range(100, 127)])
    assert len(listed.parts) == 1 and listed.parts[0].level == 3
    assert listed.epoch == 0 and listed.runs == {f"r-{i}" for i in range(27)}


def test_a_part_that_is_replaced_while_it_is_folded(table):
    for i in range(3):
        _add(table, f"r-{i}", i)

    def slow(parts, folder):
        table.read(NUMBERS, parts).write.parquet(folder)
        _add(table, "r-1", 50)

    table.fold(slow, 3)
    assert _numbers(table) == [0, 2, 50]


def test_folded_runs_are_replaced_after_they_are_taken_out(table):
    for i in range(3):
        _add(table, f"r-{i}", i)
    _fold(table)
    with pytest.raises(ValueError, match="folded"):
        _add(table, "r-1", 7)
    table.without("r-1", lambda part, folder: table.read(NUMBERS, [part]).filter("n <> 1").write.parquet(folder))
    _add(table, "r-1", 7)
    assert _numbers(table) == [0, 2, 7]


def test_expired_folders_are_removed(table):
    for i in range(9):
        _add(table, f"r-{i}", i)
        _fold(table)
    kept = table.listed()
    assert table.expire(versions=1)
    assert table.listed() == kept and _numbers(table) == list(range(9))
    folders = table._fs().listStatus(table._at(""))
    assert len([f for f in folders if f.getPath().getName().startswith("part=")]) == len(kept.parts)


# --- the log and the index ----------------------------------------------------------


def _landed(spark):
    return fixtures.landed(fixtures.table(spark, SF_SMALL, "events"))


def _same(a, b):
    columns = ["id", "data_type", "symbol", "last_updated", "raw_data", "usable"]
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def _latest(spark, path, **options):
    return store.latest_snapshot(store_table.store_of_log(spark, path), how="rank", salts=1, **options)


def test_log_and_index_through_runs_folds_and_repeats(spark):
    path, landed = new_folder(spark, "test-log"), _landed(spark)
    for i in range(5):
        landing.ingest_landed_payloads(landed.filter(F.col("seq") % 5 == i), path, f"r-{i}")
        if i == 1:
            assert _same(newest_index.latest_of_log(spark, path), _latest(spark, path))
    store_table.fold_log(spark, path, fan=4)
    assert len(store_table.log_table(spark, path).listed().parts) == 1
    expected = responses.process_responses(landed)
    assert sorted(map(str, store_table.scan_log(spark, path).collect())) == sorted(map(str, expected.collect()))
    assert _same(newest_index.latest_of_log(spark, path), _latest(spark, path))
    # A run that was folded comes again with fewer rows: what it had is gone, also from the index.
    landing.ingest_landed_payloads(landed.filter("seq % 5 = 2 AND value > 50"), path, "r-2")
    left = landed.filter("seq % 5 <> 2 OR value > 50")
    assert _same(
        store_table.store_of_log(spark, path), responses.accepted_snapshots(responses.process_responses(left))
    )
    assert _same(newest_index.latest_of_log(spark, path), _latest(spark, path))
    # In chunks of few rows, of one type, and without the empty ones.
    small = newest_index.latest_of_log(spark, path, chunk_rows=40)
    assert _same(small, _latest(spark, path))
    usable = newest_index.latest_of_log(spark, path, "economic", only_usable=True)
    assert _same(usable, _latest(spark, path, data_type="economic").filter("usable"))


def test_newest_payloads_are_not_shuffled_and_other_files_not_read(spark):
    path = new_folder(spark, "test-log")
    at = [datetime(2024, 1, d) for d in (1, 2)]
    for run, day in enumerate(at):
        rows = [(i, "e", "news", f"S{i}", 200, '[{"title":"x"}]', day) for i in range(20)]
        rows += [(100 + i, "e", "news", f"T{run}-{i}", 200, '[{"title":"x"}]', day) for i in range(20 * run)]
        landing.ingest_landed_payloads(spark.createDataFrame(rows, responses.LANDING_DDL), path, f"r-{run}")
    latest = newest_index.latest_of_log(spark, path, chunk_rows=1)
    assert latest.count() == 40 and {r["last_updated"] for r in latest.collect()} == {at[1]}
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hash" not in plan
    parts = store_table.log_table(spark, path).listed().parts
    read = {name for name in latest.inputFiles() if "/outcome=" in name}
    old, new = (sorted(p.folder for p in parts if f"r-{i}" in p.runs)[0] for i in range(2))
    assert read and all(new in f and old not in f for f in read)


def test_empty_log(spark):
    path = new_folder(spark, "test-log")
    assert store_table.scan_log(spark, path).collect() == []
    assert newest_index.latest_of_log(spark, path).collect() == []

"""The snapshot store and the response log as Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapfolio.functions import has_content
from snapfolio.operators.responses import accepted_requests, accepted_snapshots
from snapfolio.operators.store import STORE_DDL
from snapfolio.sources.runs import FAN, Part, RunTable

LOG_DDL = (
    "id BIGINT, data_type STRING, symbol STRING, last_updated TIMESTAMP_NTZ, endpoint STRING, "
    "status INT, outcome STRING, problem STRING, raw_data STRING, usable BOOLEAN"
)


def _clustered(df: DataFrame, *partitions: str) -> DataFrame:
    """Rows of a partition together and sorted by symbol.

    REBALANCE lets AQE split a partition of any size into files of the advisory size
    and merge small ones, so a hot data type is written by many tasks and a small one
    by few. Sorting makes the min/max statistics of ``symbol`` selective.
    """
    return df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, "symbol")


def append_snapshot(snapshots: DataFrame, path: str) -> None:
    """Append snapshots to the store; nothing that is there is changed."""
    if "usable" not in snapshots.columns:
        snapshots = snapshots.withColumn("usable", has_content(F.col("raw_data")))
    columns = ["id", "data_type", "symbol", "last_updated", "raw_data", "usable"]
    _clustered(snapshots.select(columns), "data_type").write.mode("append").partitionBy(
        "data_type"
    ).parquet(path)


def scan_snapshots(spark: SparkSession, path: str, data_type: str | None = None) -> DataFrame:
    """The store, or the partition of one data type."""
    store = spark.read.schema(STORE_DDL).parquet(path)
    return store if data_type is None else store.filter(F.col("data_type") == data_type)


def log_table(spark: SparkSession, path: str) -> RunTable:
    return RunTable(spark, path)


def _write_log(rows: DataFrame, folder: str) -> None:
    _clustered(rows, "outcome", "data_type").write.mode("overwrite").partitionBy("outcome", "data_type").parquet(folder)


def append_log(log: DataFrame, path: str, run: str | None = None) -> None:
    """Append processed responses in a single write, by outcome and data type.

    Every run has a folder of its own, which readers see once it is whole. A run that is repeated under its name
    replaces what it wrote before, so a failed or repeated job counts nothing twice.
    """
    table, run = log_table(log.sparkSession, path), run or uuid.uuid4().hex
    folder = table.new_folder()
    _write_log(log.withColumn("run", F.lit(run)), table.folder(folder))

    def others(part: Part, target: str) -> None:
        _write_log(_rows(table, [part]).filter(F.col("run") != run), target)

    table.without(run, others)
    table.enter(folder, [run])


def _rows(table: RunTable, parts: Iterable[Part] | None = None) -> DataFrame:
    return table.read(f"{LOG_DDL}, run STRING", parts)


def fold_log(spark: SparkSession, path: str, fan: int = FAN) -> None:
    """Put small runs together, as often as there are ``fan`` of one level. No row is changed or lost, and
    readers see either the runs or what they were put into."""
    table = log_table(spark, path)
    table.fold(lambda parts, folder: _write_log(_rows(table, parts), folder), fan)


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs that are listed now."""
    names = [c.split()[0] for c in LOG_DDL.split(", ")]
    return _rows(log_table(spark, path)).select(names)


def store_of_log(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot store kept in a response log."""
    return accepted_snapshots(scan_log(spark, path))


def ledger_of_log(spark: SparkSession, path: str) -> DataFrame:
    """The request ledger kept in a response log."""
    return accepted_requests(scan_log(spark, path))

"""Streams over landed responses, the request ledger and the snapshot store.

All queries take ``available_now=True`` to work off what is there and stop.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from snapfolio.catalog import DAILY_LIMIT
from snapfolio.operators.ledger import admit_within_budget, daily_request_total, request_counts
from snapfolio.operators.responses import process_responses
from snapfolio.operators.store import KEY, STORE_DDL, latest_snapshot
from snapfolio.sources.runs import FAN, RunTable
from snapfolio.sources.store_table import append_log, fold_log


def _start(writer, available_now: bool) -> StreamingQuery:
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _stream_name(checkpoint: str) -> str:
    return f"{zlib.crc32(checkpoint.rstrip('/').encode()):08x}"


def stream_ingest(
    landed: DataFrame, log_path: str, checkpoint: str, available_now: bool = False, fan: int = FAN
) -> StreamingQuery:
    """Landed responses into the response log, each exactly once.

    Stateless: classification and reshaping run where the files are read. A micro-batch is
    a run of the log like any batch job's, so both can share a log; a repeated one replaces
    what it wrote. Small runs are folded as they add up, so the log stays a few parts.
    """
    name = _stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_log(process_responses(batch), log_path, f"stream-{name}-{batch_id}")
        fold_log(batch.sparkSession, log_path, fan)

    writer = landed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, available_now)


def _add_batch(
    rows: DataFrame, path: str, run: str, schema: str, combine: Callable[[DataFrame], DataFrame], fan: int
) -> None:
    """Enter what a micro-batch gives as a run of its own and fold levels by ``combine``. A batch that is there
    already, which a stream repeats with the same rows, adds nothing."""
    table = RunTable(rows.sparkSession, path)
    if run in table.listed().runs:
        return
    folder = table.new_folder()
    rows.write.parquet(table.folder(folder))
    table.enter(folder, [run], once=True)
    table.fold(lambda parts, target: combine(table.read(schema, parts)).write.parquet(target), fan)


COUNTS_DDL = "endpoint STRING, date DATE, count BIGINT"


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("endpoint", "date").agg(F.sum("count").alias("count"))


def stream_request_counts(
    log: DataFrame, path: str, checkpoint: str, available_now: bool = False, fan: int = FAN
) -> StreamingQuery:
    """Counts per endpoint and day of every micro-batch, however late its requests are.

    No state is kept, so no day is ever closed. Counts of several batches are added up as they become many, and
    a batch that is repeated after a failure counts once. Read the sums with ``read_request_counts``.
    """
    name = _stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        _add_batch(request_counts(batch), path, f"stream-{name}-{batch_id}", COUNTS_DDL, _summed, fan)

    writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, available_now)


def read_request_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts over all batches."""
    return _summed(RunTable(spark, path).read(COUNTS_DDL))


def _wall_clock(ts: Column) -> Column:
    """The wall clock's time as if it were that of UTC, whose days are the windows of a stream."""
    return F.concat(ts.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")


def stream_closed_counts(
    log: DataFrame, path: str, checkpoint: str, delay: str = "1 day", available_now: bool = False, fan: int = FAN
) -> StreamingQuery:
    """Counts per endpoint and day, each written once: when the watermark, ``delay`` behind the newest request,
    has passed the day's end.

    Open days are kept in Spark's state, a number per endpoint and day, added up before they are shuffled.
    Requests that come after their day is closed are not in its count; ``read_closed_counts`` adds them. Requests
    without time belong to no day.
    """
    name = _stream_name(checkpoint)
    timed = log.select("endpoint", _wall_clock(F.col("ts")).alias("ts")).filter("ts is not null")
    days = (
        timed.withWatermark("ts", delay)
        .groupBy("endpoint", F.window("ts", "1 day").alias("day"))
        .agg(F.count("*").alias("count"))
    )
    # The day's start again as it is in UTC, whatever the session's zone.
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("day.start") / 86400).cast("int"))
    closed = days.select("endpoint", date.alias("date"), "count")

    def write(batch: DataFrame, batch_id: int) -> None:
        _add_batch(batch, path, f"stream-{name}-{batch_id}", COUNTS_DDL, _summed, fan)

    writer = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, available_now)


def read_closed_counts(spark: SparkSession, path: str, counts_path: str) -> DataFrame:
    """The closed days with ``count``, all their requests, and ``late``, those that came after the day was closed.

    ``counts_path`` is what ``stream_request_counts`` keeps of the same log. It misses no request, so the requests that it has
    beyond a day's closing count are the late ones, each counted once. A day that it is behind with has no late ones yet.
    """
    on_time = _summed(RunTable(spark, path).read(COUNTS_DDL)).withColumnRenamed("count", "on_time")
    every = read_request_counts(spark, counts_path)
    both = on_time.alias("c").join(
        every.alias("e"),
        F.col("c.endpoint").eqNullSafe(F.col("e.endpoint")) & (F.col("c.date") == F.col("e.date")), "left",
    )
    count = F.greatest(F.coalesce("e.count", F.lit(0)), "on_time")
    return both.select("c.endpoint", "c.date", count.alias("count"), (count - F.col("on_time")).alias("late"))


ADMITTED_DDL = "request_id BIGINT, ts TIMESTAMP_NTZ, admitted BOOLEAN"
SPENT_DDL = "date DATE, total BIGINT"


def _spent(totals: DataFrame) -> DataFrame:
    return totals.groupBy("date").agg(F.sum("total").alias("total"))


def _spent_by(decisions: DataFrame) -> DataFrame:
    admitted = decisions.filter("admitted").withColumn("endpoint", F.lit("all"))
    return daily_request_total(request_counts(admitted))


def stream_admissions(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    daily_limit: int = DAILY_LIMIT,
    available_now: bool = False,
    fan: int = FAN,
    schema: str = ADMITTED_DDL,
) -> StreamingQuery:
    """Decide for every request, as it arrives, whether the budget of its day allows it.

    What a day has spent is carried from one micro-batch to the next, a number per day in a table beside the
    decisions. A batch is decided by ``admit_within_budget``, so no task takes a whole day however many of its requests
    arrive at once, which a state per day would have it do. Requests are admitted in the order of their batches, and of (ts,
    request_id) within one: split in that order, they get the decisions of one batch job.

    A batch is entered with its decisions first and its spending second. If it is repeated in between, its
    decisions stand and the spending is made from them; repeated later, it changes nothing. Requests without
    time are not admitted. ``schema`` gives the types of ``request_id`` and ``ts``.
    """
    name = _stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, f"stream-{name}-{batch_id}"
        decided, spent = RunTable(spark, f"{path}/decided"), RunTable(spark, f"{path}/spent")
        if run not in decided.listed().runs:
            used = _spent(spent.read(SPENT_DDL))
            decisions = admit_within_budget(batch.select("request_id", "ts"), used, daily_limit)
            folder = decided.new_folder()
            decisions.select("request_id", "ts", "admitted").write.parquet(decided.folder(folder))
            decided.enter(folder, [run], once=True)
        if run not in spent.listed().runs:
            # Parts are folded after their spending is entered, so this run still has its own.
            own = [p for p in decided.listed().parts if run in p.runs]
            _add_batch(_spent_by(decided.read(schema, own)), f"{path}/spent", run, SPENT_DDL, _spent, fan)
        decided.fold(lambda parts, to: decided.read(schema, parts).hint("rebalance").write.parquet(to), fan)

    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, available_now)


def read_admissions(spark: SparkSession, path: str, schema: str = ADMITTED_DDL) -> DataFrame:
    """The decisions on all requests so far."""
    return RunTable(spark, f"{path}/decided").read(schema)


def _newest(snapshots: DataFrame) -> DataFrame:
    return latest_snapshot(snapshots, how="rank")


def stream_latest_snapshot(
    snapshots: DataFrame, path: str, checkpoint: str, available_now: bool = False, fan: int = FAN
) -> StreamingQuery:
    """Keep the newest snapshot of every key while snapshots arrive.

    A batch adds at most one row per key as a part of its own, so its cost depends on
    the batch and not on the number of keys seen so far. ``fan`` parts of one level become one of the next, with
    one row per key; a payload is rewritten once a level, and readers look at few parts however many batches
    there were. A repeated batch changes nothing. Read the result with ``read_latest``.
    """
    name = _stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        _add_batch(_newest(batch), path, f"stream-{name}-{batch_id}", STORE_DDL, _newest, fan)

    writer = (
        snapshots.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    return _start(writer, available_now)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot per key over all batches."""
    return latest_snapshot(RunTable(spark, path).read(STORE_DDL))


def compact_latest(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest snapshot per key as a fresh table, for use as a store."""
    read_latest(spark, path).hint("rebalance", "data_type").sortWithinPartitions(
        *KEY
    ).write.mode("errorifexists").partitionBy("data_type").parquet(target)

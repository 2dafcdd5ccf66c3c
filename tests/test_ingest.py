"""Landed responses in batch and as a stream."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapfolio.catalog import spec_for
from snapfolio.operators import ledger, responses, store
from snapfolio.operators.responses import LANDING_DDL
from snapfolio.plans.views import dataset_view
from snapfolio.sources import landing, store_table
from snapfolio.sources.scratch import new_folder
from snapfolio.streaming import streams

CASES = [
    # data type, status, body, outcome, problem, kept
    ("income", 200, "[]", "empty", None, "[]"),
    ("income", 200, "{}", "empty", None, "{}"),
    ("income", 200, "null", "empty", None, "null"),
    ("income", 200, '[{"date":"x"}]', "accepted", None, '[{"date":"x"}]'),
    ("income", 200, '{"Error Message":"x"}', "quarantined", "not_an_array", '{"Error Message":"x"}'),
    ("income", 200, "[1]", "quarantined", "not_records", "[1]"),
    ("income", 404, '[{"date":"x"}]', "http_error", None, '[{"date":"x"}]'),
    ("income", None, None, "http_error", None, None),
    ("income", 200, None, "parse_error", None, None),
    ("income", 200, "oops", "parse_error", None, "oops"),
    ("income", 200, '[{"date":"x"}', "parse_error", None, '[{"date":"x"}'),
    ("price", 200, '{"historical":[]}', "accepted", None, "[]"),
    ("price", 200, '{"historical":null}', "accepted", None, "null"),
    ("price", 200, '{"symbol":"X"}', "empty", None, '{"symbol":"X"}'),
    ("price", 200, '[{"date":"x"}]', "empty", None, '[{"date":"x"}]'),
    ("price", 200, '[{"historical":[1]}]', "empty", None, '[{"historical":[1]}]'),
    ("price", 200, '{"symbol":"X","historical":[{"open":1}]}', "accepted", None, '[{"open":1}]'),
    # Taken out of its envelope, NaN becomes text; decoded as a number it is NaN again.
    ("price", 200, '{"historical":[{"open":NaN}]}', "accepted", None, '[{"open":"NaN"}]'),
    ("price", 200, '{"historical":{"a":1}}', "quarantined", "not_an_array", '{"a":1}'),
    ("outlook", 200, '{"metrics":{}}', "accepted", None, '{"metrics":{}}'),
    ("outlook", 200, "[1]", "quarantined", "not_an_object", "[1]"),
    ("revenue", 200, '{"breakdown":{}}', "accepted", None, '{"breakdown":{}}'),
    ("revenue", 200, '{"other":1}', "empty", None, '{"other":1}'),
    ("revenue", 200, '{"breakdown":[]}', "quarantined", "breakdown_not_an_object", '{"breakdown":[]}'),
]


@pytest.fixture(scope="module")
def landed(spark):
    found = [
        (i, f"/v3/{t}", t, f" s{i % 4} ", status, body, datetime(2024, 1, 1 + i % 2, 10, i))
        for i, (t, status, body, *_) in enumerate(CASES)
    ]
    found.append((len(CASES), "/v3/income", "income", "  ", 200, "[{}]", datetime(2024, 1, 1)))
    return spark.createDataFrame(found, LANDING_DDL)


def _log_rows(df):
    return sorted(tuple(r) for r in df.select("id", "outcome", "problem", "raw_data").collect())


EXPECTED = [(i, o, p, k) for i, (_, _, _, o, p, k) in enumerate(CASES)] + [
    (len(CASES), "no_key", None, "[{}]")
]


def test_outcomes(landed):
    assert _log_rows(responses.process_responses(landed)) == EXPECTED


def test_nan_is_kept(landed):
    log = responses.process_responses(landed).filter("id = 17")
    view = dataset_view(responses.accepted_snapshots(log), spec_for("price"))
    assert math.isnan(view.first()["Open"])


def test_ids_without_sequence_are_stable(landed):
    rows = landed.drop("seq")
    first = responses.process_responses(rows).select("id").collect()
    again = responses.process_responses(rows.repartition(5)).select("id").collect()
    assert sorted(first) == sorted(again) and len(set(first)) == len(first)


def test_log_holds_store_and_ledger(spark, landed):
    path = new_folder(spark, "test-log")
    landing.ingest_landed_payloads(landed, path)
    assert _log_rows(store_table.scan_log(spark, path)) == EXPECTED
    snapshots = store_table.store_of_log(spark, path)
    assert sorted(r["id"] for r in snapshots.collect()) == [i for i, o, _, _ in EXPECTED if o == "accepted"]
    assert {r["symbol"] for r in snapshots.collect()} <= {"S0", "S1", "S2", "S3"}
    # Quarantined responses have cost a request all the same.
    counts = ledger.request_counts(store_table.ledger_of_log(spark, path))
    assert counts.agg(F.sum("count")).first()[0] == sum(
        o in ("accepted", "quarantined") for _, o, _, _ in EXPECTED
    )
    usable = {r["id"] for r in snapshots.filter("usable").collect()}
    assert usable == {i for i, o, _, k in EXPECTED if o == "accepted" and k not in ("[]", "null")}


def _land(spark, df, path, n):
    """Write the responses as ``n`` batches of JSON lines files."""
    for i in range(n):
        df.filter(F.col("seq") % n == i).coalesce(1).write.mode("append").json(path)


def test_json_landing_area(spark, landed):
    path = new_folder(spark, "test-landing")
    _land(spark, landed, path, 3)
    read = landing.read_landed(spark, path)
    assert _log_rows(responses.process_responses(read)) == EXPECTED


def test_stream_equals_batch_over_files_and_restart(spark, landed):
    source, log, checkpoint = (new_folder(spark, f"test-{n}") for n in ("src", "log", "ckpt"))
    half = len(CASES) // 2
    _land(spark, landed.filter(F.col("seq") < half), source, 3)
    for _ in range(2):  # the second run finds nothing new
        stream = landing.stream_landed(spark, source, maxFilesPerTrigger="1")
        streams.stream_ingest(stream, log, checkpoint, available_now=True).awaitTermination()
    assert _log_rows(store_table.scan_log(spark, log)) == EXPECTED[:half]
    _land(spark, landed.filter(F.col("seq") >= half), source, 2)
    stream = landing.stream_landed(spark, source, maxFilesPerTrigger="1")
    streams.stream_ingest(stream, log, checkpoint, available_now=True).awaitTermination()
    assert _log_rows(store_table.scan_log(spark, log)) == EXPECTED


def test_streamed_counts_and_latest_equal_batch(spark):
    n, files = 300, 5
    snapshots = spark.range(n).select(
        F.col("id"),
        F.concat(F.lit("t"), F.col("id") % 2).alias("data_type"),
        F.concat(F.lit("s"), F.col("id") % 7).alias("symbol"),
        F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, (id * 31) % 40)").alias("last_updated"),
        F.concat(F.lit('[{"n":'), F.col("id"), F.lit("}]")).alias("raw_data"),
        F.lit(True).alias("usable"),
    )
    source = new_folder(spark, "test-src")
    schema = snapshots.schema

    def run(part):
        snapshots.filter(F.col("id") % files == part).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        streams.stream_latest_snapshot(read, latest, f"{latest}-ckpt", available_now=True).awaitTermination()
        log = read.select(F.col("data_type").alias("endpoint"), F.col("last_updated").alias("ts"))
        streams.stream_request_counts(
            log, counts, f"{counts}-ckpt", available_now=True
        ).awaitTermination()

    latest, counts = new_folder(spark, "test-latest"), new_folder(spark, "test-counts")
    for part in range(files):
        run(part)
    batch = store.latest_snapshot(snapshots, how="rank")
    assert sorted(streams.read_latest(spark, latest).collect()) == sorted(batch.collect())
    target = new_folder(spark, "test-compact")
    streams.compact_latest(spark, latest, target)
    compacted = store_table.scan_snapshots(spark, target)
    assert sorted(compacted.select(batch.columns).collect()) == sorted(batch.collect())
    by_day = ledger.request_counts(
        snapshots.select(F.col("data_type").alias("endpoint"), F.col("last_updated").alias("ts"))
    )
    assert sorted(streams.read_request_counts(spark, counts).collect()) == sorted(by_day.collect())


def test_streamed_days_in_another_time_zone(spark):
    """Days are those of the wall clock, whatever the zone of the session."""
    source, out = new_folder(spark, "test-src"), new_folder(spark, "test-counts")
    log = spark.createDataFrame(
        [("e", datetime(2024, 7, 1, 0, 30)), ("e", datetime(2024, 7, 1, 23, 30)), ("e", datetime(2024, 7, 2, 1))],
        "endpoint STRING, ts TIMESTAMP_NTZ",
    )
    log.write.parquet(source)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        read = spark.readStream.schema(log.schema).parquet(source)
        streams.stream_request_counts(read, out, f"{out}-ckpt", available_now=True).awaitTermination()
        got = sorted((str(r["date"]), r["count"]) for r in streams.read_request_counts(spark, out).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [("2024-07-01", 2), ("2024-07-02", 1)]


def test_json_bodies_survive_landing(spark):
    body = json.dumps([{"title": 'a "quoted",\nline é'}])
    path = new_folder(spark, "test-landing")
    spark.createDataFrame([(1, "/v3/stock_news", "news", "a", 200, body, datetime(2024, 1, 1))], LANDING_DDL).write.json(path)
    assert responses.process_responses(landing.read_landed(spark, path)).first()["raw_data"] == body

"""Inputs that once lost data: each stands for a fault that was found."""

from datetime import date, datetime

from pyspark.sql import functions as F

from snapfolio import spec_for
from snapfolio.operators import ledger, planning, responses, store
from snapfolio.operators.shaping import explode_records, flatten_nested_map, odd_members
from snapfolio.sources import export, landing, store_table
from snapfolio.sources.runs import RunTable
from snapfolio.sources.scratch import new_folder
from snapfolio.streaming import streams

STORE = "id BIGINT, data_type STRING, symbol STRING, last_updated TIMESTAMP_NTZ, raw_data STRING"
LANDED = "seq BIGINT, endpoint STRING, data_type STRING, symbol STRING, status INT, body STRING, ts TIMESTAMP_NTZ"


def test_numbers_sent_as_text(spark):
    raw = '[{"date":"2024-01-01","open":"1.5","close":2},{"date":"2024-01-02","open":"x"}]'
    df = spark.createDataFrame([("A", raw)], "symbol STRING, raw_data STRING")
    got = explode_records(df, spec_for("price")).select("date", "open", "close").collect()
    assert [tuple(r) for r in got] == [("2024-01-01", 1.5, 2.0), ("2024-01-02", None, None)]


def test_odd_periods_take_no_others_along(spark):
    raw = '{"breakdown":{"2023":{"a":"7","b":1,"c":"x"},"2022":5,"2021":{"a":2}}}'
    df = spark.createDataFrame([("A", raw)], "symbol STRING, raw_data STRING")
    got = {(r["period"], r["segment"]): r["value"] for r in flatten_nested_map(df, "breakdown").collect()}
    assert got == {("2023", "a"): 7.0, ("2023", "b"): 1.0, ("2023", "c"): None, ("2021", "a"): 2.0}


def test_requests_are_planned_per_day(spark):
    requests = spark.createDataFrame(
        [(9, datetime(2024, 1, 1, 8), "price", "A", False), (2, datetime(2024, 1, 1, 9), "price", "A", False),
         (3, datetime(2024, 1, 2), "price", "A", True)],
        "request_id BIGINT, ts TIMESTAMP_NTZ, data_type STRING, symbol STRING, refresh BOOLEAN",
    )
    kept = spark.createDataFrame([(1, "price", "A", datetime(2024, 1, 1), "[1]")], STORE)
    got = planning.plan_requests(requests, kept).select("request_id", "ts", "decision").collect()
    assert sorted(map(tuple, got)) == [
        (3, datetime(2024, 1, 2), "fetch"), (9, datetime(2024, 1, 1, 8), "serve_cache"),
    ]


def test_keys_without_time_are_found_both_ways(spark):
    kept = spark.createDataFrame(
        [(1, "price", "A", None, "[1]"), (2, "price", "A", None, "[2]"), (3, "price", "B", datetime(2024, 1, 1), "[3]")],
        STORE,
    )
    rows = {how: sorted(map(tuple, store.latest_snapshot(kept, how=how).collect())) for how in ("lookup", "rank")}
    assert rows["lookup"] == rows["rank"]
    assert {r[0] for r in rows["rank"]} == {2, 3}


def test_rows_that_cannot_be_placed_are_not_accepted(spark):
    at = datetime(2024, 1, 1)
    landed = spark.createDataFrame(
        [(1, "e", None, "A", 200, "[1]", at), (2, "e", "nope", "A", 200, "[1]", at),
         (3, "e", " News ", "A", 200, '[{"title":"x"}]', at), (4, "e", "news", "A", 200, '[{"title":"x"}]', None),
         (None, "e", "news", "B", 200, '[{"title":"x"}]', at)],
        LANDED,
    )
    log = responses.process_responses(landed).collect()
    assert [r["outcome"] for r in log] == ["unknown_type", "unknown_type", "accepted", "no_time", "accepted"]
    assert log[2]["data_type"] == "news"
    assert all(r["id"] is not None for r in log)
    assert [r["usable"] for r in log] == [False, False, True, False, True]


def test_one_log_for_batches_streams_and_repeats(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, "e", "news", f"S{i}", 200, '[{"title":"x"}]', at) for i in range(6)]
    path, source, checkpoint = (new_folder(spark, f"test-{n}") for n in ("log", "landed", "ckpt"))
    first, second = spark.createDataFrame(rows[:3], LANDED), spark.createDataFrame(rows[3:], LANDED)
    for _ in range(2):
        landing.ingest_landed_payloads(first, path, run="one")
    second.write.json(source)
    read = landing.stream_landed(spark, source)
    streams.stream_ingest(read, path, checkpoint, available_now=True).awaitTermination()
    landing.ingest_landed_payloads(spark.createDataFrame([(9, *rows[0][1:])], LANDED), path)
    ids = [r["id"] for r in store_table.scan_log(spark, path).select("id").collect()]
    assert sorted(ids) == [0, 1, 2, 3, 4, 5, 9]


def test_late_requests_count(spark):
    source, path, checkpoint = (new_folder(spark, f"test-{n}") for n in ("requests", "counts", "ckpt"))
    for day in (10, 5, 5):
        one = spark.createDataFrame([("e", datetime(2024, 1, day))], "endpoint STRING, ts TIMESTAMP_NTZ")
        one.coalesce(1).write.mode("append").parquet(source)
    read = spark.readStream.schema("endpoint STRING, ts TIMESTAMP_NTZ").option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_request_counts(read, path, checkpoint, available_now=True).awaitTermination()
    got = {r["date"]: r["count"] for r in streams.read_request_counts(spark, path).collect()}
    assert got == {date(2024, 1, 10): 1, date(2024, 1, 5): 2}


def test_folder_names_are_those_on_disk(spark):
    path, spec = new_folder(spark, "test-export"), spec_for("news")
    symbols = ["^GSPC", "BRK/B", "A=B", "50%", "EUR:USD", "plain"]
    records = spark.createDataFrame([(s, 0, " x ") for s in symbols], "symbol STRING, pos BIGINT, title STRING")
    export.write_export(records, export.export_path(path, "news", "1"), layout="symbol")
    targets = export.export_targets(records.select("symbol"), spec, path, "1")
    names = {r["target"].rsplit("/", 1)[-1] for r in targets.collect()}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = {r["f"] for r in files.select(F.element_at(F.split("path", "/"), -2).alias("f")).collect()}
    assert names == found


def test_blanks_stay_in_csv(spark):
    path = new_folder(spark, "test-csv")
    records = spark.createDataFrame([("A", 0, "  lead and trail  ")], "symbol STRING, pos BIGINT, title STRING")
    export.write_export(records, path)
    assert "  lead and trail  " in spark.read.text(path).collect()[1][0]


LINES = [
    ('{"seq":1,"endpoint":"e","data_type":"news","symbol":"A","status":200,"body":"[{}]","ts":"2024-01-01T10:00:00Z"}', datetime(2024, 1, 1, 10)),
    ('{"seq":2,"endpoint":"e","data_type":"news","symbol":"B","status":200,"body":"[{}]","ts":"2024-01-01T10:00:00+02:00"}', datetime(2024, 1, 1, 8)),
    ('{"seq":3,"endpoint":"e","data_type":"news","symbol":"C","status":200,"body":"[{}]","ts":"2024-01-01 10:00:00.25"}', datetime(2024, 1, 1, 10, 0, 0, 250000)),
    ('{"seq":4,"endpoint":"e","data_type":"news","symbol":"D","status":200,"body":"[{}]","ts":"2024-11-03T01:30:00-05:00"}', datetime(2024, 11, 3, 6, 30)),
    ('{"seq":5,"endpoint":"e","data_type":"news","symbol":"E","status":200,"body":"[{}]","ts":"2024-11-03T01:30:00 GMT"}', datetime(2024, 11, 3, 1, 30)),
    ('{"seq":6,"endpoint":"e","data_type":"news","symbol":"F","status":200,"body":"[{}]","ts":"2024-01-05"}', datetime(2024, 1, 5)),
]
BROKEN = ['{"seq":7,"endpoint":"e","data_', "no json at all", '["an", "array"]']


def test_zoned_times_and_broken_lines(spark):
    source, batch, log, checkpoint = (new_folder(spark, f"test-{n}") for n in ("lines", "batch", "log", "ckpt"))
    odd_time = LINES[0][0].replace("2024-01-01T10:00:00Z", "soon").replace('"A"', '"G"').replace(":1,", ":8,")
    odd_id = LINES[0][0].replace('"seq":1', '"seq":"x"').replace('"A"', '"H"')
    lines = [line for line, _ in LINES] + BROKEN + [odd_time, odd_id]
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(source)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        landing.ingest_landed_payloads(landing.read_landed(spark, source), batch)
        read = landing.stream_landed(spark, source)
        streams.stream_ingest(read, log, checkpoint, available_now=True).awaitTermination()
        got = store_table.scan_log(spark, batch).collect()
        streamed = store_table.scan_log(spark, log).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(str, got)) == sorted(map(str, streamed)) and len(got) == len(lines)
    by_symbol = {r["symbol"]: r for r in got}
    for (line, at), symbol in zip(LINES, "ABCDEF", strict=True):
        assert (by_symbol[symbol]["last_updated"], by_symbol[symbol]["outcome"]) == (at, "accepted"), line
    assert by_symbol["G"]["outcome"] == "no_time" and by_symbol["H"]["outcome"] == "accepted"
    kept = [r["raw_data"] for r in got if r["outcome"] == "corrupt_line"]
    assert sorted(kept) == sorted(BROKEN)
    assert len({r["id"] for r in got}) == len(lines)


def test_every_member_of_a_map_is_shown_or_put_aside(spark):
    raw = '{"breakdown":{"2023":{"a":"7","c":"x","d":null},"2022":5,"2021":{},"2020":null,"2019":[1]}}'
    df = spark.createDataFrame([("A", raw), ("B", "[]"), ("C", None)], "symbol STRING, raw_data STRING")
    shown = {(r["period"], r["segment"]): r["value"] for r in flatten_nested_map(df, "breakdown").collect()}
    assert shown == {("2023", "a"): 7.0, ("2023", "c"): None, ("2023", "d"): None}
    aside = {(r["period"], r["segment"]): (r["raw"], r["problem"]) for r in odd_members(df, "breakdown").collect()}
    assert aside == {
        ("2022", None): ("5", "period_not_an_object"), ("2019", None): ("[1]", "period_not_an_object"),
        ("2020", None): (None, "period_not_an_object"), ("2021", None): ("{}", "period_without_segments"),
        ("2023", "c"): ("x", "value_not_a_number"),
    }


def test_many_small_batches_fold_to_few_parts(spark):
    path = new_folder(spark, "test-counts")
    at = spark.createDataFrame([("e", datetime(2024, 1, 1))], "endpoint STRING, ts TIMESTAMP_NTZ")
    counted = ledger.request_counts(at).coalesce(1)
    for i in range(40):
        streams._add_batch(counted, path, f"stream-x-{i}", streams.COUNTS_DDL, streams._summed, fan=3)
        if i % 7 == 0:  # repeated after a failure
            streams._add_batch(counted, path, f"stream-x-{i}", streams.COUNTS_DDL, streams._summed, fan=3)
    assert len(RunTable(spark, path).listed().parts) <= 6
    assert [r["count"] for r in streams.read_request_counts(spark, path).collect()] == [40]

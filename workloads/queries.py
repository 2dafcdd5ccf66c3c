"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapfolio.catalog import CATALOG, DatasetSpec, spec_for
from snapfolio.functions import decode_payload, encode_payload, has_content, normalize_key
from snapfolio.operators import ledger, planning, responses, shaping, store
from snapfolio.plans.views import dataset_view, view_totals
from snapfolio.sources import export, newest_index, store_table
from snapfolio.sources.landing import ingest_landed_payloads, read_landed
from snapfolio.sources.scratch import new_folder
from snapfolio.streaming import streams
from workloads import fixtures

Query = Callable[[SparkSession, str], DataFrame]

# --- store ----------------------------------------------------------------------


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_snapshot(fixtures.events_store(spark, sf_dir))


def cache_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cache_summary(fixtures.events_store(spark, sf_dir))


def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.type_summary(fixtures.events_store(spark, sf_dir), "purchase", "symbol")


def type_summary_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    indicators = fixtures.events_store(spark, sf_dir).select(
        "id", F.col("data_type").alias("symbol"), F.lit("economic").alias("data_type"),
        "last_updated", "raw_data",
    )
    return store.type_summary(indicators, "economic")


def cached_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cached_keys(fixtures.events_store(spark, sf_dir), "click")


def nonempty_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a low value count as empty payloads."""
    events = fixtures.table(spark, sf_dir, "events")
    emptied = events.withColumn("props", F.when(F.col("value") < 20, "[]").otherwise(F.col("props")))
    return store.nonempty_latest(
        emptied.selectExpr(
            "event_id AS id", "event_type AS data_type", "CAST(user_id AS STRING) AS symbol",
            "ts AS last_updated", "props AS raw_data",
        )
    )


def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = decode_payload(F.col("raw_data"), "STRUCT<k: BIGINT>")
    return (
        fixtures.events_store(spark, sf_dir)
        .select("id", value.alias("v"))
        .select("id", "v.k", encode_payload(F.col("v")).alias("encoded"))
    )


def append_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, by the value of the event, make the whole store."""
    path = new_folder(spark, "store")
    events = fixtures.events_store(spark, sf_dir)
    recent = F.col("last_updated") >= F.lit("2024-01-15").cast("timestamp_ntz")
    store_table.append_snapshot(events.filter(~recent), path)
    store_table.append_snapshot(events.filter(recent), path)
    return store_table.scan_snapshots(spark, path)


# --- ledger ---------------------------------------------------------------------


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.request_counts(fixtures.request_log(spark, sf_dir))


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merge_counts(_counts(spark, sf_dir), _counts(spark, sf_dir))


def daily_request_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily_request_total(_counts(spark, sf_dir))


def request_total_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day with requests and one without any."""
    counts = _counts(spark, sf_dir)
    busy = ledger.request_total_on(counts, F.lit("2024-01-15").cast("date"))
    return busy.unionByName(ledger.request_total_on(counts, F.lit("1999-01-01").cast("date")))


def limit_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.limit_reached(ledger.daily_request_total(_counts(spark, sf_dir)))


def _event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "events").selectExpr("event_id AS request_id", "ts")


def admit_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.admit_within_budget(_event_requests(spark, sf_dir))


def admit_after_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's purchases have already used a part of the budget."""
    spent = fixtures.request_log(spark, sf_dir).filter(F.col("endpoint") == "purchase")
    used = ledger.daily_request_total(ledger.request_counts(spent))
    return ledger.admit_within_budget(_event_requests(spark, sf_dir), used)


# --- requests and responses -------------------------------------------------------


def plan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_requests(
        fixtures.orders_as_requests(spark, sf_dir), fixtures.events_store(spark, sf_dir)
    )


def plan_every_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request decided by itself, also several a day for one key."""
    return planning.plan_requests(
        fixtures.orders_as_requests(spark, sf_dir), fixtures.events_store(spark, sf_dir), once_a_day=False
    )


def request_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    data_type = F.expr(
        "CASE left(o_orderpriority, 1) WHEN '1' THEN 'price' WHEN '2' THEN 'income' "
        "WHEN '3' THEN 'estimates' WHEN '4' THEN 'economic' ELSE 'news' END"
    )
    key = F.concat(F.lit(" c"), F.col("o_custkey").cast("string"))
    requests = fixtures.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        data_type.alias("data_type"),
        normalize_key(key, data_type).alias("symbol"),
    )
    return planning.request_path(requests)


def classify_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = fixtures.landed(fixtures.table(spark, sf_dir, "events"))
    return responses.classify_response(landed).select("seq", "data_type", "outcome")


def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names between odd kinds of white space; nothing but that for negative balances."""
    name = F.when(F.col("c_acctbal") < 0, F.lit(" \t ")).otherwise(
        F.concat(F.lit("  \t"), F.col("c_name"), F.lit(" \n"))
    )
    data_type = F.when(F.col("c_mktsegment") == "BUILDING", "economic").otherwise("price")
    return responses.normalize_keys(
        fixtures.table(spark, sf_dir, "customer").select(
            "c_custkey", name.alias("symbol"), data_type.alias("data_type")
        )
    ).select("c_custkey", "symbol")


def quarantine_bad_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = fixtures.landed(fixtures.table(spark, sf_dir, "events")).selectExpr(
        "seq AS id", "data_type", "body AS raw_data"
    )
    return responses.quarantine_bad_payloads(landed).select("id", "data_type", "problem")


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "log")
    ingest_landed_payloads(fixtures.landed(fixtures.table(spark, sf_dir, "events")), path)
    return path


def ingest_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_table.scan_log(spark, _ingested(spark, sf_dir))


def ingest_odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with zoned times, and lines that cannot be read, which keep their text."""
    lines, path = new_folder(spark, "landed"), new_folder(spark, "log")
    fixtures.landed_lines(spark, sf_dir, lines)
    ingest_landed_payloads(read_landed(spark, lines), path)
    return store_table.scan_log(spark, path).select(
        F.when(F.col("outcome") != responses.CORRUPT_LINE, F.col("id")).alias("id"), "data_type", "last_updated",
        "outcome", "raw_data",
    )


#: Runs that the landed responses come in, and how many of one level are folded.
RUNS, FAN = 3, 2


def _ingested_in_runs(spark: SparkSession, sf_dir: str) -> str:
    """The log of the landed responses in several runs, one of which is repeated, folded after each."""
    path = new_folder(spark, "log")
    events = fixtures.landed(fixtures.table(spark, sf_dir, "events"))
    for run in (*range(RUNS), 1):
        ingest_landed_payloads(events.filter(F.col("seq") % RUNS == run), path, f"run-{run}")
        store_table.fold_log(spark, path, fan=FAN)
    return path


def folded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_table.scan_log(spark, _ingested_in_runs(spark, sf_dir))


def latest_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest snapshots of a log of several runs, by its index."""
    return newest_index.latest_of_log(spark, _ingested_in_runs(spark, sf_dir))


def ingested_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.request_counts(store_table.ledger_of_log(spark, _ingested(spark, sf_dir)))


# --- shaping --------------------------------------------------------------------


# The snapshots of the fixtures are computed, two per symbol: rank them, reading them once.
ONCE = {"how": "rank", "salts": 1}


def _latest(spark: SparkSession, sf_dir: str, data_type: str) -> tuple[DataFrame, DatasetSpec]:
    snapshots = fixtures.snapshots(spark, sf_dir, data_type)
    return store.latest_snapshot(snapshots, data_type, **ONCE), spec_for(data_type)


def _stored(spark: SparkSession, sf_dir: str, data_type: str) -> DataFrame:
    """The snapshots written as a store, and read back from it."""
    path = new_folder(spark, "store")
    store_table.append_snapshot(fixtures.snapshots(spark, sf_dir, data_type), path)
    return store_table.scan_snapshots(spark, path, data_type)


def explode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.explode_records(*_latest(spark, sf_dir, "balance"))


def unwrap_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of one priority lack the member and are dropped."""
    member = F.when(F.col("symbol").startswith("5"), '{"history":').otherwise('{"historical":')
    bodies = fixtures.packed_records(spark, sf_dir, "dividends").select(
        "symbol",
        F.concat(member, encode_payload(F.col("records")), F.lit(',"note":"x"}')).alias("body"),
    )
    inner = responses.unwrap_envelope(bodies, "historical")
    return shaping.explode_records(
        inner.withColumnRenamed("body", "raw_data"), spec_for("dividends")
    )


def extract_nested_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest, spec = _latest(spark, sf_dir, "outlook")
    return shaping.extract_nested_object(latest, "profile", spec.record_ddl)


def flatten_nested_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest, _ = _latest(spark, sf_dir, "revenue")
    return shaping.flatten_nested_map(latest, "breakdown")


def odd_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of breakdowns: what is shown, and beside it what is odd."""
    breakdowns = fixtures.odd_breakdowns(spark, sf_dir)
    shown = shaping.flatten_nested_map(breakdowns, "breakdown").select(
        "*", F.lit(None).cast("string").alias("raw"), F.lit("shown").alias("problem")
    )
    odd = shaping.odd_members(breakdowns, "breakdown").withColumn("value", F.lit(None).cast("double"))
    return shown.unionByName(odd)


def project_known_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest, spec = _latest(spark, sf_dir, "metrics")
    return shaping.project_known_columns(shaping.explode_records(latest, spec), spec)


def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest, spec = _latest(spark, sf_dir, "ratios")
    return shaping.rename_columns(shaping.explode_records(latest, spec), spec)


def sort_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.sort_newest_first(*_latest(spark, sf_dir, "targets"))


def top_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over record rows of users, of whom any may hold a large share."""
    records = fixtures.table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS symbol", "event_id AS pos",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS transactionDate", "value AS price",
    )
    return shaping.top_n_per_key(records, spec_for("insider"), 10)


def record_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.record_totals(
        fixtures.table(spark, sf_dir, "orders").select(
            F.col("o_custkey").cast("string").alias("symbol")
        )
    )


def payload_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.payload_position(*_latest(spark, sf_dir, "holders"))


def totals_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_totals(fixtures.snapshots(spark, sf_dir, "targets"), spec_for("targets"), **ONCE)


def _view(spec: DatasetSpec) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dataset_view(fixtures.snapshots(spark, sf_dir, spec.data_type), spec, **ONCE)

    return query


# --- exports --------------------------------------------------------------------


def _record_schema(spec: DatasetSpec, *lead: str) -> str:
    return ", ".join([*lead, *(f"`{f.key}` {f.sql_type}" for f in spec.fields)])


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, path = spec_for("grades"), new_folder(spark, "csv")
    export.export_csv(
        export.export_records(fixtures.snapshots(spark, sf_dir, "grades"), spec, **ONCE), path
    )
    schema = _record_schema(spec, "symbol STRING", "pos BIGINT")
    return spark.read.options(**export.CSV_OPTIONS).schema(schema).csv(path)


def export_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spec_for("cashflow")
    path = export.export_all_keys(
        fixtures.snapshots(spark, sf_dir, "cashflow"), spec, new_folder(spark, "exports"),
        run="20240601_120000", **ONCE,
    )
    return export.read_files(spark, path, _record_schema(spec, "pos BIGINT")).select("pos", *spec.keys, "symbol")


def export_named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per symbol under its own name, read back with the name it was read from."""
    spec, folder, run = spec_for("marketcap"), new_folder(spark, "exports"), "20240601_120000"
    path = export.export_all_keys(
        fixtures.snapshots(spark, sf_dir, "marketcap"), spec, folder, run, layout="file", only_declared=True, **ONCE
    )
    read = export.read_files(spark, path, _record_schema(spec, "pos BIGINT"))
    # Names that Spark's readers of files take for hidden, as those of null symbols, are left out here as well.
    return read.filter(~F.col("file").rlike("^[_.]")).select("file", "pos", *spec.keys)


def export_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spec_for("balance")
    symbols = store.cached_keys(fixtures.snapshots(spark, sf_dir, "balance"), "balance")
    return export.export_targets(symbols, spec, "exports", "20240601_120000")


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = fixtures.snapshots(spark, sf_dir, "holders")
    return export.export_records(snapshots, spec_for("holders"), **ONCE)


def export_records_all_payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots, spec = fixtures.snapshots(spark, sf_dir, "metrics"), spec_for("metrics")
    record_ddl = export.infer_record_type(snapshots, spec, how="rank")
    return export.export_records(snapshots, spec, record_ddl=record_ddl, **ONCE)


def export_whole_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of the payloads, as exports have them by default."""
    return export.export_records(_stored(spark, sf_dir, "metrics"), spec_for("metrics"))


def export_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = fixtures.snapshots(spark, sf_dir, "revenue")
    return export.export_records(snapshots, spec_for("revenue"), **ONCE)


def view_price_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, look up and show: the whole way through a stored table."""
    return dataset_view(_stored(spark, sf_dir, "price"), spec_for("price"))


def export_csv_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, path = spec_for("splits"), new_folder(spark, "csv")
    export.export_csv(export.export_records(_stored(spark, sf_dir, "splits"), spec), path)
    schema = _record_schema(spec, "symbol STRING", "pos BIGINT")
    return spark.read.options(**export.CSV_OPTIONS).schema(schema).csv(path)


def select_export_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = (
        fixtures.table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") > 5000)
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    )
    return export.export_records(
        fixtures.snapshots(spark, sf_dir, "growth"), spec_for("growth"), keys=chosen, **ONCE
    )


# --- streams --------------------------------------------------------------------


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "stream-log")
    landed = fixtures.landed(fixtures.events_stream(spark, sf_dir))
    streams.stream_ingest(
        landed, path, new_folder(spark, "checkpoint"), available_now=True
    ).awaitTermination()
    return store_table.scan_log(spark, path)


def stream_request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "stream-counts")
    log = fixtures.events_stream(spark, sf_dir).selectExpr("event_type AS endpoint", "ts")
    streams.stream_request_counts(
        log, path, new_folder(spark, "checkpoint"), available_now=True
    ).awaitTermination()
    return streams.read_request_counts(spark, path)


def stream_closed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, every = new_folder(spark, "stream-closed"), new_folder(spark, "stream-counts")
    log = fixtures.events_stream(spark, sf_dir).selectExpr("event_type AS endpoint", "ts")
    for start, path in ((streams.stream_closed_counts, closed), (streams.stream_request_counts, every)):
        start(log, path, new_folder(spark, "checkpoint"), available_now=True).awaitTermination()
    return streams.read_closed_counts(spark, closed, every)


def stream_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "stream-admitted")
    requests = fixtures.events_stream(spark, sf_dir).selectExpr("event_id AS request_id", "ts")
    streams.stream_admissions(requests, path, new_folder(spark, "checkpoint"), available_now=True).awaitTermination()
    return streams.read_admissions(spark, path)


def stream_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "stream-latest")
    snapshots = fixtures.events_stream(spark, sf_dir).selectExpr(
        "event_id AS id", "event_type AS data_type", "CAST(user_id AS STRING) AS symbol",
        "ts AS last_updated", "props AS raw_data",
    ).withColumn("usable", has_content(F.col("raw_data")))
    streams.stream_latest_snapshot(
        snapshots, path, new_folder(spark, "checkpoint"), available_now=True
    ).awaitTermination()
    return streams.read_latest(spark, path)


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "latest_snapshot": latest_snapshot,
        "cache_summary": cache_summary,
        "type_summary": type_summary,
        "type_summary_indicator": type_summary_indicator,
        "cached_keys": cached_keys,
        "nonempty_latest": nonempty_latest,
        "decode_payload": decode,
        "append_snapshot": append_snapshot,
        "request_counts": request_counts,
        "merge_counts": merge_counts,
        "daily_request_total": daily_request_total,
        "request_total_on": request_total_on,
        "limit_reached": limit_reached,
        "admit_within_budget": admit_within_budget,
        "admit_after_spending": admit_after_spending,
        "plan_requests": plan_requests,
        "plan_every_request": plan_every_request,
        "request_path": request_path,
        "classify_response": classify_response,
        "normalize_key": normalize_keys,
        "quarantine_bad_payloads": quarantine_bad_payloads,
        "ingest_landed_payloads": ingest_landed,
        "ingested_requests": ingested_requests,
        "ingest_odd_lines": ingest_odd_lines,
        "folded_log": folded_log,
        "latest_of_log": latest_of_log,
        "explode_records": explode_records,
        "unwrap_envelope": unwrap_envelope,
        "extract_nested_object": extract_nested_object,
        "flatten_nested_map": flatten_nested_map,
        "odd_members": odd_members,
        "project_known_columns": project_known_columns,
        "rename_columns": rename_columns,
        "sort_newest_first": sort_newest_first,
        "top_n_per_key": top_n_per_key,
        "record_totals": record_totals,
        "payload_position": payload_position,
        "view_totals": totals_of_view,
        "export_csv": export_csv,
        "export_all_keys": export_all_keys,
        "export_named_files": export_named_files,
        "export_path": export_path,
        "export_records": export_records,
        "export_records_all_payload_keys": export_records_all_payload_keys,
        "export_whole_records": export_whole_records,
        "export_breakdown": export_breakdown,
        "select_export_keys": select_export_keys,
        "view_price_from_store": view_price_from_store,
        "export_csv_from_store": export_csv_from_store,
        "stream_ingest": stream_ingest,
        "stream_request_counts": stream_request_counts,
        "stream_closed_counts": stream_closed_counts,
        "stream_admissions": stream_admissions,
        "stream_latest_snapshot": stream_latest_snapshot,
    }
    named.update({f"view_{spec.data_type}": _view(spec) for spec in CATALOG})
    return named

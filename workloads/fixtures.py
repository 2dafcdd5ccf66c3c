"""Snapshots, requests and landed responses made from the given tables.

Only test data is made here; no operator depends on it. A payload is one API response
and so of bounded size: rows are packed into payloads by a key that includes a block
of consecutive ids (at most ``BLOCK`` rows), a calendar month or a calendar year, never by a
key that can hold any number of rows.

The expressions in ``FIELDS`` and ``LANDED`` are valid in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapfolio.catalog import NESTED_MAP, NESTED_OBJECT, DatasetSpec, spec_for
from snapfolio.functions import encode_payload

BLOCK = 64  # events and orders per payload, over all their keys
TEXT_BLOCK = 256  # documents per payload, over all sources

# Payload keys of every data type: the family of base rows and an expression per key.
# Keys that are not displayed are there to be ignored; ``roe`` of metrics is left out.
FIELDS: dict[str, tuple[str, dict[str, str]]] = {
    "price": ("events", {
        "date": "day_time", "open": "value", "high": "value + 1", "low": "value - 1",
        "close": "value + 0.5", "volume": "event_id"}),
    "dividends": ("orders", {
        "date": "day", "label": "o_orderpriority", "adjDividend": "o_totalprice / 2",
        "dividend": "o_totalprice"}),
    "splits": ("orders", {
        "date": "day", "numerator": "o_custkey", "denominator": "o_orderkey",
        "splitRatio": "CAST(o_custkey AS STRING) || ':' || CAST(o_orderkey AS STRING)"}),
    "marketcap": ("events", {"date": "day_time", "marketCap": "value"}),
    "income": ("months", {
        "date": "month", "revenue": "price", "netIncome": "quantity", "grossProfit": "tax",
        "eps": "discount"}),
    "balance": ("months", {
        "date": "month", "totalAssets": "price", "totalLiabilities": "quantity",
        "totalEquity": "discount"}),
    "cashflow": ("months", {
        "date": "month", "operatingCashFlow": "price", "investingCashFlow": "quantity",
        "financingCashFlow": "tax"}),
    "metrics": ("months", {
        "currency": "'USD'", "date": "month", "peRatio": "price", "marketCap": "quantity",
        "dividendYield": "discount"}),
    "ratios": ("months", {
        "date": "month", "currentRatio": "price", "quickRatio": "quantity",
        "debtEquityRatio": "discount", "returnOnEquity": "tax"}),
    "growth": ("months", {
        "date": "month", "revenueGrowth": "price", "netIncomeGrowth": "quantity",
        "epsGrowth": "discount"}),
    "estimates": ("months", {
        "date": "month", "estimatedRevenueAvg": "price", "estimatedEpsAvg": "discount"}),
    "earnings": ("months", {
        "date": "month", "eps": "tax", "epsEstimated": "discount", "revenue": "price",
        "revenueEstimated": "quantity"}),
    "targets": ("orders", {
        "publishedDate": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE day END",
        "analystName": "o_orderpriority", "priceTarget": "o_totalprice",
        "adjPriceTarget": "o_totalprice / 4"}),
    "grades": ("orders", {
        "date": "day", "gradingCompany": "o_orderpriority", "grade": "o_orderstatus",
        "previousGrade": "CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderstatus END"}),
    "esg": ("months", {
        "date": "month", "environmentalScore": "price", "socialScore": "quantity",
        "governanceScore": "discount", "total": "tax"}),
    "economic": ("events", {"date": "day_time", "value": "value"}),
    "news": ("documents", {"publishedDate": "day", "title": "text", "site": "lang"}),
    "filings": ("documents", {"filingDate": "day", "type": "lang", "title": "text"}),
    "insider": ("events", {
        "transactionDate": "day_time", "insiderName": "CAST(user_id AS STRING)",
        "transactionType": "event_type", "shares": "event_id", "price": "value"}),
    "holders": ("orders", {
        "dateReported": "day", "holder": "o_orderpriority", "shares": "o_orderkey",
        "value": "o_totalprice"}),
    "profile": ("customers", {
        "companyName": "c_name", "industry": "c_mktsegment", "sector": "r_name",
        "website": "CAST(NULL AS STRING)", "price": "c_acctbal"}),
    "outlook": ("customers", {
        "companyName": "c_name", "price": "c_acctbal", "beta": "c_acctbal / 10000",
        "volAvg": "c_nationkey", "mktCap": "c_acctbal * 1000"}),
}

# Which column orders the records of a payload (unique within a payload).
PAYLOAD_ORDER = {
    "events": ("value", "event_id"),
    "orders": ("o_orderkey",),
    "months": ("month",),
    "documents": ("doc_id",),
    "customers": ("c_custkey",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- base rows ----------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"event_type || '-' || CAST(event_id DIV {BLOCK} AS STRING) AS symbol",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS day_time",
        "event_id", "event_type", "user_id", "value",
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        f"left(o_orderpriority, 1) || '-' || CAST(o_orderkey DIV {BLOCK} AS STRING) AS symbol",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day",
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
    )


def _exact_sum(column: str):
    """A sum of amounts in cents, which does not depend on the order of the rows."""
    cents = F.floor(F.col(column) * 100 + F.lit(0.5))
    return (F.sum(cents).cast("double") / 100).alias(column)


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.trunc("l_shipdate", "MM").alias("first_day"))
        .agg(*map(_exact_sum, ("l_extendedprice", "l_quantity", "l_discount", "l_tax")))
        .select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
            F.date_format("first_day", "yyyy-MM-dd").alias("month"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
        )
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        f"upper(source) || '-' || CAST(doc_id DIV {TEXT_BLOCK} AS STRING) AS symbol",
        "date_format(date_add(DATE '2020-01-01', CAST(n_chars % 365 AS INT)), 'yyyy-MM-dd') AS day",
        "doc_id", "text", "lang",
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr("'C' || CAST(c_custkey AS STRING) AS symbol", "c_custkey", "c_name",
                    "c_mktsegment", "c_acctbal", "c_nationkey", "r_name")
    )


_FAMILIES = {
    "events": _events,
    "orders": _orders,
    "months": _months,
    "documents": _documents,
    "customers": _customers,
}


def base_rows(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    return _FAMILIES[family](spark, sf_dir)


# --- snapshots ----------------------------------------------------------------


def events_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a snapshot store: type = event type, symbol = user, payload = props."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "event_type AS data_type", "CAST(user_id AS STRING) AS symbol",
        "ts AS last_updated", "props AS raw_data",
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the log of accepted requests."""
    return table(spark, sf_dir, "events").selectExpr("event_type AS endpoint", "ts")


def packed_records(spark: SparkSession, sf_dir: str, data_type: str) -> DataFrame:
    """``symbol`` and ``records``: the payload records of every symbol as an array."""
    family, fields = FIELDS[data_type]
    rows = base_rows(spark, sf_dir, family)
    order = PAYLOAD_ORDER[family]
    values = [F.expr(e).alias(k) for k, e in fields.items()]
    rows = rows.select(
        _symbol(data_type).alias("symbol"),
        F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)],
                 F.struct(*values).alias("record")).alias("ordered"),
    )
    packed = rows.groupBy("symbol").agg(F.array_sort(F.collect_list("ordered")).alias("ordered"))
    return packed.select("symbol", F.transform("ordered", lambda r: r["record"]).alias("records"))


def _symbol(data_type: str):
    fold = F.lower if spec_for(data_type).key_case == "lower" else F.upper
    return fold("symbol")


def _with_older_versions(current: DataFrame, older, data_type: str) -> DataFrame:
    """Every payload with an older one that must lose: by time, or by id where times tie."""
    tie = F.pmod(F.octet_length("raw"), F.lit(2)) == 0
    now = F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")
    before = F.when(tie, now).otherwise(F.expr("TIMESTAMP_NTZ '2024-05-31 00:00:00'"))
    base = F.pmod(F.xxhash64("symbol"), F.lit(1 << 60)) * 2
    versions = F.array(
        F.struct(base.alias("id"), before.alias("last_updated"), older.alias("raw_data")),
        F.struct((base + 1).alias("id"), now.alias("last_updated"), F.col("raw").alias("raw_data")),
    )
    return current.select("symbol", F.explode(versions).alias("v")).select(
        "v.id", F.lit(data_type).alias("data_type"), "symbol", "v.last_updated", "v.raw_data"
    )


def snapshots(spark: SparkSession, sf_dir: str, data_type: str) -> DataFrame:
    """A store with two snapshots for every symbol of a data type."""
    spec = spec_for(data_type)
    if spec.shape == NESTED_MAP:
        current = _breakdown_payloads(spark, sf_dir)
        older = F.lit('{"breakdown":{"1900":{"old":1}}}')
    elif spec.shape == NESTED_OBJECT:
        current = _outlook_payloads(spark, sf_dir, spec)
        older = F.lit('{"profile":{"companyName":"old"}}')
    else:
        current = packed_records(spark, sf_dir, data_type).select(
            "symbol", encode_payload(F.col("records")).alias("raw")
        )
        older = F.lit(f'[{{"{spec.keys[0]}":"9999-12-31"}}]')
    return _with_older_versions(current, older, data_type)


def _outlook_payloads(spark: SparkSession, sf_dir: str, spec: DatasetSpec) -> DataFrame:
    """Customers as outlooks; those of one market segment have no profile."""
    _, fields = FIELDS[spec.data_type]
    profile = F.struct(*[F.expr(e).alias(k) for k, e in fields.items()])
    return base_rows(spark, sf_dir, "customers").select(
        "symbol",
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit('{"metrics":{}}'))
        .otherwise(encode_payload(F.struct(profile.alias("profile"))))
        .alias("raw"),
    )


def breakdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag")
        .agg(_exact_sum("l_extendedprice"))
        .select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
            F.col("year").cast("string").alias("period"),
            F.col("l_returnflag").alias("segment"),
            # Some values are null: they are shown all the same.
            F.when(F.col("year") != 1999, F.col("l_extendedprice")).alias("value"),
        )
    )


def _breakdown_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.map_from_entries(F.collect_list(F.struct("segment", "value")))
    periods = F.map_from_entries(F.collect_list(F.struct("period", "segments")))
    return (
        breakdown_rows(spark, sf_dir)
        .groupBy("symbol", "period")
        .agg(segments.alias("segments"))
        .groupBy("symbol")
        .agg(periods.alias("breakdown"))
        .select("symbol", encode_payload(F.struct("breakdown")).alias("raw"))
    )


# What is odd in these breakdowns: a period of one number, one without segments, a value that is text.
ODD_PERIOD, EMPTY_PERIOD, ODD_VALUE = "1995", "1996", ("1997", "R")


def odd_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakdowns as ``symbol, raw_data`` with periods and values that are not what they should be."""
    rows = breakdown_rows(spark, sf_dir)
    odd = (F.col("period") == ODD_VALUE[0]) & (F.col("segment") == ODD_VALUE[1])
    text = F.when(odd, F.lit('"n/a"')).otherwise(F.coalesce(F.col("value").cast("string"), F.lit("null")))
    pair = F.concat(F.lit('"'), "segment", F.lit('":'), text)
    inner = F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(pair)), ","), F.lit("}"))
    periods = rows.groupBy("symbol", "period").agg(inner.alias("inner"))
    shown = (
        F.when(F.col("period") == ODD_PERIOD, F.lit("5"))
        .when(F.col("period") == EMPTY_PERIOD, F.lit("{}"))
        .otherwise(F.col("inner"))
    )
    member = F.concat(F.lit('"'), "period", F.lit('":'), shown)
    whole = F.concat(F.lit('{"breakdown":{'), F.array_join(F.sort_array(F.collect_list(member)), ","), F.lit("}}"))
    return periods.groupBy("symbol").agg(whole.alias("raw_data"))


# --- landed responses -----------------------------------------------------------

DATA_TYPE_OF_EVENT = (
    "CASE event_type WHEN 'view' THEN 'price' WHEN 'click' THEN 'income' "
    "WHEN 'purchase' THEN 'revenue' WHEN 'signup' THEN 'outlook' ELSE 'economic' END"
)

_DAY = "CAST(CAST(ts AS DATE) AS STRING)"
_N = "CAST(event_id AS STRING)"

# A well-formed body per event type, and what of it is kept.
KEPT_BODY = (
    "CASE event_type "
    f"""WHEN 'view' THEN '[{{"date":"' || {_DAY} || '","open":' || {_N} || '}}]' """
    f"""WHEN 'click' THEN '[{{"date":"' || {_DAY} || '","revenue":' || {_N} || '}}]' """
    f"""WHEN 'purchase' THEN '{{"breakdown":{{"' || {_DAY} || '":{{"all":' || {_N} || '}}}}}}' """
    f"""WHEN 'signup' THEN '{{"profile":{{"companyName":"u","price":' || {_N} || '}}}}' """
    f"""ELSE '[{{"date":"' || {_DAY} || '","value":' || {_N} || '}}]' END"""
)

# The hour of the event picks the body; all kinds of bad ones occur.
BODY = (
    "CASE hour(ts) WHEN 0 THEN '[]' WHEN 1 THEN '{}' WHEN 2 THEN 'null' WHEN 3 THEN 'oops' "
    """WHEN 4 THEN '{"Error Message":"limit"}' WHEN 5 THEN '[1,' WHEN 6 THEN '{"historical":[]}' """
    """WHEN 7 THEN '{"breakdown":{}}' WHEN 8 THEN '[{"date":"x"}] trailing' WHEN 9 THEN '  [ ] ' """
    """WHEN 10 THEN '"text"' WHEN 11 THEN '[1,2]' WHEN 12 THEN '{"breakdown":[1]}' """
    f"""ELSE CASE WHEN event_type = 'view' THEN '{{"historical":' || {KEPT_BODY} || '}}' """
    f"ELSE {KEPT_BODY} END END"
)

STATUS = "CASE WHEN value < 5 THEN 500 ELSE 200 END"
RAW_KEY = "CASE WHEN value > 200 THEN '   ' ELSE '  u' || CAST(user_id AS STRING) || ' ' END"


def landed(events: DataFrame) -> DataFrame:
    """Events as landed responses; works on a batch and on a stream."""
    return events.selectExpr(
        "event_id AS seq", "event_type AS endpoint", f"{DATA_TYPE_OF_EVENT} AS data_type",
        f"{RAW_KEY} AS symbol", f"{STATUS} AS status", f"{BODY} AS body", "ts",
    )


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream over its file."""
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )


def landed_lines(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Events as JSON lines: times with and without zone, and lines that are cut off."""
    events = landed(table(spark, sf_dir, "events"))
    local = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = F.when(F.col("seq") % 3 == 0, F.concat(local, F.lit("+02:00"))).when(
        F.col("seq") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    ).otherwise(plain)
    line = F.to_json(F.struct("seq", "endpoint", "data_type", "symbol", "status", "body", text.alias("ts")))
    cut = F.when(F.col("seq") % 10 == 7, F.concat(F.lit('{"seq":'), F.col("seq"))).otherwise(line)
    events.select(cut.alias("value")).write.text(path)


# --- requests -------------------------------------------------------------------


def orders_as_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests for event snapshots of users; a year counts as one day."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id",
        "CAST(date_trunc('YEAR', o_orderdate) AS TIMESTAMP_NTZ) AS ts",
        "CASE o_orderstatus WHEN 'O' THEN 'view' WHEN 'P' THEN 'click' ELSE 'purchase' END"
        " AS data_type",
        "' ' || CAST(o_custkey AS STRING) AS symbol",
        "o_orderpriority = '1-URGENT' AS refresh",
    )

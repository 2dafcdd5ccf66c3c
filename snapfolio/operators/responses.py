"""From landed API responses to accepted snapshots.

A landed response is ``seq, endpoint, data_type, symbol, status, body, ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from snapfolio.catalog import (
    CATALOG,
    ENVELOPE,
    NESTED_MAP,
    NESTED_OBJECT,
    RECORDS,
    data_types_where,
)
from snapfolio.functions import (
    decode_payload,
    is_falsy,
    is_valid_json,
    member_text,
    normalize_key,
    payload_kind,
)
from snapfolio.functions.payload import has_member

LANDING_DDL = (
    "seq BIGINT, endpoint STRING, data_type STRING, symbol STRING, status INT, "
    "body STRING, ts TIMESTAMP_NTZ"
)

ACCEPTED = "accepted"
QUARANTINED = "quarantined"
EMPTY = "empty"
HTTP_ERROR = "http_error"
PARSE_ERROR = "parse_error"
NO_KEY = "no_key"
UNKNOWN_TYPE = "unknown_type"
NO_TIME = "no_time"
#: The column of landed lines that were not understood, and their outcome if nothing of them was.
CORRUPT_LINE = "corrupt_line"


def _members() -> dict[str, list[str]]:
    """The members that data types insist on, and the types that do."""
    names = sorted({s.required_key for s in CATALOG if s.required_key})
    return {m: data_types_where(lambda s: s.required_key == m) for m in names}


def required_member(body: Column, data_type: Column) -> Column:
    """JSON text of the member the data type insists on; NULL if it is null or missing."""
    text = F.lit(None).cast("string")
    for member, types in _members().items():
        text = F.when(
            data_type.isin(types),
            F.when(payload_kind(body) == "object", member_text(body, member)),
        ).otherwise(text)
    return text


def _lacks_member(body: Column, data_type: Column, member: Column) -> Column:
    """Whether the required member is missing; keys are looked up only if its text is NULL."""
    lacks = F.lit(False)
    for name, types in _members().items():
        lacks = F.when(data_type.isin(types), ~has_member(body, name)).otherwise(lacks)
    return member.isNull() & lacks


def _outcome(status: Column, body: Column, data_type: Column, valid: Column, member: Column) -> Column:
    return (
        F.when(status.isNull() | (status != 200), HTTP_ERROR)
        .when(~valid, PARSE_ERROR)
        .when(is_falsy(body), EMPTY)
        .when(_lacks_member(body, data_type, member), EMPTY)
        .otherwise(ACCEPTED)
    )


def response_outcome(status: Column, body: Column, data_type: Column) -> Column:
    """``accepted``, ``empty``, ``http_error`` or ``parse_error``."""
    member = required_member(body, data_type)
    return _outcome(status, body, data_type, is_valid_json(body), member)


def classify_response(responses: DataFrame) -> DataFrame:
    """Add the ``outcome`` of every response."""
    return responses.withColumn(
        "outcome", response_outcome(F.col("status"), F.col("body"), F.col("data_type"))
    )


def normalize_keys(responses: DataFrame) -> DataFrame:
    """Trim and fold ``symbol``; a key that is empty afterwards becomes NULL."""
    return responses.withColumn("symbol", normalize_key(F.col("symbol"), F.col("data_type")))


def unwrap_envelope(responses: DataFrame, member: str) -> DataFrame:
    """Keep bodies that are objects with ``member`` and replace them by its JSON text."""
    return responses.filter(has_member(F.col("body"), member)).withColumn(
        "body", F.coalesce(member_text(F.col("body"), member), F.lit("null"))
    )


def _shape_problem(raw: Column, data_type: Column, member: Column) -> Column:
    """Why valid JSON has the wrong shape; ``member`` is the text of a map of maps."""
    kind = payload_kind(raw)
    lists = data_types_where(lambda s: s.shape in (RECORDS, ENVELOPE))
    objects = data_types_where(lambda s: s.shape in (NESTED_OBJECT, NESTED_MAP))
    records = decode_payload(raw, "ARRAY<STRUCT<__probe: STRING>>")
    problem = (
        F.when(is_falsy(raw), F.lit(None).cast("string"))
        .when(data_type.isin(lists) & (kind != "array"), "not_an_array")
        .when(data_type.isin(lists) & records.isNull(), "not_records")
        .when(data_type.isin(objects) & (kind != "object"), "not_an_object")
    )
    for name in sorted({s.member for s in CATALOG if s.shape == NESTED_MAP}):
        types = data_types_where(lambda s: s.shape == NESTED_MAP and s.member == name)
        inner = payload_kind(F.coalesce(member, F.lit("null")))
        problem = problem.when(data_type.isin(types) & (inner != "object"), f"{name}_not_an_object")
    return problem


def payload_problem(raw: Column, data_type: Column) -> Column:
    """Why a stored payload has the wrong shape for its data type; NULL if it is fine.

    An empty payload (``[]``, ``null``) is fine: it is stored, and hides older ones.
    ``from_json`` alone does not tell: with an array type it turns an error object
    into an array of one empty record.
    """
    shape = _shape_problem(raw, data_type, required_member(raw, data_type))
    return F.when(~is_valid_json(raw), "malformed").otherwise(shape)


def quarantine_bad_payloads(snapshots: DataFrame) -> DataFrame:
    """Add ``problem``: NULL for well-shaped payloads, else the reason for rejecting them."""
    return snapshots.withColumn(
        "problem", payload_problem(F.col("raw_data"), F.col("data_type"))
    )


def process_responses(landed: DataFrame) -> DataFrame:
    """Turn landed responses into the response log, one row for every row that landed.

    ``outcome`` says what became of it. ``accepted`` rows are the snapshot store,
    ``accepted`` and ``quarantined`` rows together are the request ledger, so the two
    come from one write and cannot disagree. Rows that are not accepted keep their
    body as ``raw_data``. Types that are not in the catalogue and rows without a time cannot be
    placed, so they are neither snapshots nor requests. A line of which nothing could be read keeps its text
    (``corrupt_line``) as ``raw_data``; if some fields could be read, they are judged. Works on batch and streaming DataFrames: no shuffle, no state.
    """
    # A row without ``seq`` gets an id that is the same whenever the row is read again.
    told = ["endpoint", "data_type", "symbol", "ts", "status", "body"]
    line = F.lit(None).cast("string")
    if CORRUPT_LINE in landed.columns:
        nothing = F.coalesce(*[F.col(c).cast("string") for c in told]).isNull()
        line = F.when(nothing, F.col(CORRUPT_LINE))
        told.append(CORRUPT_LINE)
    seq = F.xxhash64(*told)
    if "seq" in landed.columns:
        seq = F.coalesce(F.col("seq"), seq)
    body, data_type = F.col("body"), F.col("data_type")
    rows = landed.withColumn("_seq", seq).withColumn("_line", line).withColumn("data_type", F.lower(F.trim("data_type")))
    rows = normalize_keys(rows)
    # Each of these columns is used more than once by the next, so Spark computes it once.
    rows = rows.withColumn("_valid", (F.col("status") == 200) & is_valid_json(body))
    rows = rows.withColumn(
        "_member", F.when(F.col("_valid"), required_member(body, data_type))
    )
    rows = rows.withColumn(
        "outcome",
        _outcome(F.col("status"), body, data_type, F.col("_valid"), F.col("_member")),
    )
    accepted = F.col("outcome") == ACCEPTED
    envelopes = data_types_where(lambda s: s.shape == ENVELOPE)
    kept = F.when(
        accepted & data_type.isin(envelopes), F.coalesce("_member", F.lit("null"))
    ).otherwise(body)
    rows = rows.withColumn("raw_data", kept)
    rows = rows.withColumn(
        "problem",
        F.when(accepted, _shape_problem(F.col("raw_data"), data_type, F.col("_member"))),
    )
    outcome = (
        F.when(F.col("_line").isNotNull(), CORRUPT_LINE)
        .when(F.col("symbol").isNull(), NO_KEY)
        .when(~F.coalesce(data_type.isin(data_types_where(lambda s: True)), F.lit(False)), UNKNOWN_TYPE)
        .when(F.col("ts").isNull(), NO_TIME)
        .when(F.col("problem").isNotNull(), QUARANTINED)
        .otherwise(F.col("outcome"))
    )
    return rows.select(
        F.col("_seq").alias("id"),
        "data_type",
        "symbol",
        F.col("ts").alias("last_updated"),
        "endpoint",
        "status",
        outcome.alias("outcome"),
        "problem",
        F.coalesce("_line", "raw_data").alias("raw_data"),
        ((outcome == ACCEPTED) & ~is_falsy(F.col("raw_data"))).alias("usable"),
    )


def accepted_snapshots(log: DataFrame) -> DataFrame:
    """The snapshot store within a response log."""
    return log.filter(F.col("outcome") == ACCEPTED).select(
        "id", "data_type", "symbol", "last_updated", "raw_data", "usable"
    )


def accepted_requests(log: DataFrame) -> DataFrame:
    """The request ledger within a response log; payloads are not read."""
    return log.filter(F.col("outcome").isin(ACCEPTED, QUARANTINED)).select(
        "endpoint", F.col("last_updated").alias("ts")
    )

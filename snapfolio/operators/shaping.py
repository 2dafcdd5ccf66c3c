"""Payloads to typed rows.

Two forms of the same steps exist. ``top_n_per_key`` and ``record_totals`` work on rows
and serve any record table. The functions that take snapshots work inside one payload:
it is a single row, so its records can be sorted and cut without a shuffle, and this
is what the dataset views use.

The decoded payload is a column of its own, used twice in the next step. Spark then
keeps the two steps apart and decodes every payload once. A filter on the decoded
column, also the one Spark infers for exploding a plain column, would be pushed below
that step and decode a second time. So the records are an expression, not a column,
and rows without records are dropped by exploding it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from snapfolio.catalog import ENVELOPE, NESTED_MAP, RECORDS, DatasetSpec
from snapfolio.functions import decode_payload, payload_kind
from snapfolio.operators.ranking import DEFAULT_SALTS, top_per_key


def _any_value(record: Column, keys: list[str]) -> Column:
    return F.coalesce(*[record[k].cast("string") for k in keys]).isNotNull()


def _any_key(maps: Column, keys: list[str]) -> Column:
    """Whether any of the objects has any of the keys, also with a null value."""
    none = F.array().cast("array<string>")
    found = F.flatten(F.transform(maps, lambda m: F.coalesce(F.map_keys(m), none)))
    return F.coalesce(F.arrays_overlap(found, F.array(*map(F.lit, keys))), F.lit(False))


def decoded_records(
    snapshots: DataFrame, spec: DatasetSpec, record_ddl: str | None = None
) -> tuple[DataFrame, Column]:
    """Snapshots with their payloads decoded, and the records in payload order.

    The records are an array expression over the returned DataFrame. It is NULL for a
    payload of the wrong outer form (``from_json`` would turn an object into an array of
    one record) and for one whose records have none of the displayed keys. A declared
    type cannot tell a missing key from a null value, so the keys themselves are
    looked up, but only where every value is NULL.
    """
    if spec.shape == NESTED_MAP:
        raise ValueError(f"{spec.data_type}: a map of maps has no record array")
    raw, decoded = F.col("raw_data"), F.col("_decoded")
    # Numbers may arrive as text, so declared fields are read as text and cast.
    texts = record_ddl is None and any(f.sql_type != "STRING" for f in spec.fields)
    if texts:
        record_ddl = "STRUCT<" + ", ".join(f"`{f.key}`: STRING" for f in spec.fields) + ">"
    record_ddl = record_ddl or spec.record_ddl
    if spec.shape in (RECORDS, ENVELOPE):
        kind, value, records = "array", decode_payload(raw, f"ARRAY<{record_ddl}>"), decoded
        maps = decode_payload(raw, "ARRAY<MAP<STRING, STRING>>")
    else:
        nested = f"STRUCT<`{spec.member}`: {record_ddl}>"
        kind, value = "object", decode_payload(raw, nested)
        records = F.array(decoded[spec.member])
        nested_map = f"STRUCT<`{spec.member}`: MAP<STRING, STRING>>"
        maps = F.array(decode_payload(raw, nested_map)[spec.member])
    if texts:
        records = F.transform(
            records,
            lambda r: F.when(
                r.isNotNull(),
                F.struct(*[r[f.key].try_cast(f.sql_type).alias(f.key) for f in spec.fields]),
            ),
        )
    shown = F.exists(records, lambda r: _any_value(r, spec.keys)) | _any_key(maps, spec.keys)
    rows = snapshots.select(
        "symbol", "raw_data", F.when(payload_kind(raw) == kind, value).alias("_decoded")
    )
    return rows, F.when(shown, records)


def explode_records(
    snapshots: DataFrame, spec: DatasetSpec, record_ddl: str | None = None
) -> DataFrame:
    """Every record of every snapshot: ``symbol, pos`` and its keys."""
    rows, records = decoded_records(snapshots, spec, record_ddl)
    return rows.select("symbol", F.posexplode(records).alias("pos", "_r")).select(
        "symbol", F.col("pos").cast("long").alias("pos"), "_r.*"
    )


def sort_newest_first(
    snapshots: DataFrame, spec: DatasetSpec, first: int | None = None
) -> DataFrame:
    """Records with ``rank``, their place in display order, all or the ``first`` ones.

    Newest means the greatest sort key as text, NULL last, equal ones by position;
    without a sort key it is the payload order.
    """
    rows, records = decoded_records(snapshots, spec)

    def cut(array: Column) -> Column:
        return array if first is None else F.slice(array, 1, first)

    if spec.sort_key is None:
        exploded = rows.select("symbol", F.posexplode(cut(records)).alias("_i", "record"))
        pos = F.col("_i")
    else:
        # Descending by (key, -position) puts NULL keys last and keeps equal keys in order.
        keyed = F.transform(
            records,
            lambda r, i: F.struct(r[spec.sort_key].alias("key"), (-i).alias("back"), r.alias("record")),
        )
        exploded = rows.select(
            "symbol", F.posexplode(cut(F.sort_array(keyed, asc=False))).alias("_i", "_r")
        ).select("symbol", "_i", "_r.back", "_r.record")
        pos = -F.col("back")
    return exploded.select(
        "symbol",
        (F.col("_i") + 1).cast("long").alias("rank"),
        pos.cast("long").alias("pos"),
        "record.*",
    )


def payload_position(snapshots: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The original position of every record, with its sort key."""
    records = explode_records(snapshots, spec)
    return records.select("symbol", "pos", spec.sort_key or spec.keys[0])


def extract_nested_object(snapshots: DataFrame, member: str, ddl: str) -> DataFrame:
    """One row per snapshot whose payload has the object ``member``."""
    value = decode_payload(F.col("raw_data"), f"STRUCT<`{member}`: {ddl}>")[member]
    return (
        snapshots.withColumn("_value", value)
        .filter(F.col("_value").isNotNull())
        .select("symbol", "_value.*")
    )


def flatten_nested_map(snapshots: DataFrame, member: str) -> DataFrame:
    """A map of maps as rows (symbol, period, segment, value); null values are kept.

    A map promises no order, so the rows have no position.
    """
    periods = decode_payload(F.col("raw_data"), f"STRUCT<`{member}`: MAP<STRING, STRING>>")[member]
    # Each period and each number by itself: one that is odd takes no other with it.
    segments = decode_payload(F.col("_period"), "MAP<STRING, STRING>")
    return (
        snapshots.select("symbol", F.explode(periods).alias("period", "_period"))
        .filter(payload_kind(F.col("_period")) == "object")
        .select("symbol", "period", F.explode(segments).alias("segment", "_value"))
        .select("symbol", "period", "segment", F.col("_value").try_cast("double").alias("value"))
    )


def odd_members(snapshots: DataFrame, member: str) -> DataFrame:
    """What ``flatten_nested_map`` cannot show, or not as it is: ``symbol, period, segment, raw, problem``.

    Periods that are no objects and those without segments have no shown row; values that are no numbers are shown as
    NULL. Together with the shown rows that is every member of the map.
    """
    periods = decode_payload(F.col("raw_data"), f"STRUCT<`{member}`: MAP<STRING, STRING>>")[member]
    kind = F.coalesce(payload_kind(F.col("_period")), F.lit("null"))
    segments = F.when(kind == "object", decode_payload(F.col("_period"), "MAP<STRING, STRING>"))
    rows = snapshots.select("symbol", F.explode(periods).alias("period", "_period")).select(
        "symbol", "period", "_period", kind.alias("_kind"), segments.alias("_segments")
    )
    none = F.lit(None).cast("string")
    whole = F.when(F.col("_kind") != "object", "period_not_an_object").when(
        F.size("_segments") == 0, "period_without_segments"
    )
    odd = F.map_filter("_segments", lambda _, v: v.isNotNull() & v.try_cast("double").isNull())
    parts = rows.select("symbol", "period", F.explode(odd).alias("segment", "raw")).withColumn(
        "problem", F.lit("value_not_a_number")
    )
    return (
        rows.select("symbol", "period", none.alias("segment"), F.col("_period").alias("raw"), whole.alias("problem"))
        .filter("problem IS NOT NULL")
        .unionByName(parts)
    )


def project_known_columns(records: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The displayed keys in their order, after ``symbol`` and ``pos`` where present."""
    lead = [c for c in ("symbol", "rank", "pos") if c in records.columns]
    return records.select(*lead, *spec.keys)


def rename_columns(records: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Payload keys to display labels."""
    return records.withColumnsRenamed({k: v for k, v in spec.labels.items() if k in records.columns})


def newest_record_first(spec: DatasetSpec) -> list[Column]:
    order = [F.desc_nulls_last(spec.sort_key)] if spec.sort_key else []
    return [*order, F.asc("segment") if spec.shape == NESTED_MAP else F.asc("pos")]


def top_n_per_key(
    records: DataFrame, spec: DatasetSpec, n: int, salts: int = DEFAULT_SALTS
) -> DataFrame:
    """The first ``n`` records of every symbol in display order, numbered in ``rank``."""
    ranked = top_per_key(records, ["symbol"], newest_record_first(spec), n, salts=salts)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def record_totals(records: DataFrame, shown: int = 10) -> DataFrame:
    """Records per symbol, and whether a view of ``shown`` rows leaves some out."""
    return (
        records.groupBy("symbol")
        .agg(F.count("*").alias("total"))
        .withColumn("truncated", F.col("total") > shown)
    )

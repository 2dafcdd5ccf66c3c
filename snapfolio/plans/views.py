"""One view per data type: the newest rows of every symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snapfolio.catalog import NESTED_MAP, DatasetSpec
from snapfolio.operators.ranking import DEFAULT_SALTS
from snapfolio.operators.shaping import (
    decoded_records,
    flatten_nested_map,
    project_known_columns,
    record_totals,
    rename_columns,
    sort_newest_first,
    top_n_per_key,
)
from snapfolio.operators.store import latest_snapshot


def dataset_view(
    store: DataFrame, spec: DatasetSpec, how: str = "lookup", salts: int = DEFAULT_SALTS
) -> DataFrame:
    """The view of a data type for all symbols: ``symbol, rank, pos`` and the labels.

    ``rank`` is the display order, ``pos`` the position in the payload (maps have none).
    Empty and badly shaped payloads give no rows. A payload is decoded once, after all
    but the newest have been dropped (``how``, see ``latest_snapshot``), and its records
    are sorted and cut within their row, without a further shuffle.
    """
    latest = latest_snapshot(store, spec.data_type, how, salts)
    if spec.shape == NESTED_MAP:
        rows = flatten_nested_map(latest, spec.member)
        # The rows of a symbol come from one payload, so they are few: no salting.
        rows = top_n_per_key(rows, spec, spec.top_n, salts=1)
    else:
        rows = sort_newest_first(latest, spec, first=spec.top_n)
    return rename_columns(project_known_columns(rows, spec), spec)


def view_totals(
    store: DataFrame, spec: DatasetSpec, how: str = "lookup", salts: int = DEFAULT_SALTS
) -> DataFrame:
    """How many records each symbol has, and whether its view leaves some out."""
    latest = latest_snapshot(store, spec.data_type, how, salts)
    if spec.shape == NESTED_MAP:
        return record_totals(flatten_nested_map(latest, spec.member), spec.top_n)
    rows, records = decoded_records(latest, spec)
    sizes = rows.select("symbol", F.size(records).alias("_size"))
    truncated = F.col("total") > spec.top_n if spec.top_n is not None else F.lit(False)
    # There is one row per symbol already; the aggregate keeps the filter above decoding.
    return (
        sizes.groupBy("symbol")
        .agg(F.max("_size").cast("long").alias("total"))
        .filter("total > 0")
        .withColumn("truncated", truncated)
    )

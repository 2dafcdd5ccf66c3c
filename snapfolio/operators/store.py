"""The snapshot store: latest payloads and summaries.

A store is a DataFrame ``id, data_type, symbol, last_updated, raw_data`` that only
ever grows. A boolean column ``usable`` (payload is not empty), written at ingest,
is used where it exists, so that planning need not read payloads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from snapfolio.catalog import spec_for
from snapfolio.functions import has_content
from snapfolio.operators.ranking import DEFAULT_SALTS, top_per_key
from snapfolio.sources.scratch import written

STORE_DDL = (
    "id BIGINT, data_type STRING, symbol STRING, last_updated TIMESTAMP_NTZ, "
    "raw_data STRING, usable BOOLEAN"
)

KEY = ("data_type", "symbol")


def newest_first() -> list[Column]:
    """Newest snapshot first; among equal times the one inserted last."""
    return [F.desc("last_updated"), F.desc("id")]


def usable_flag(store: DataFrame) -> Column:
    return F.col("usable") if "usable" in store.columns else has_content(F.col("raw_data"))


def of_type(store: DataFrame, data_type: str) -> DataFrame:
    return store.filter(F.col("data_type") == data_type)


def newest_times(store: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The newest time per key, found without reading payloads."""
    return store.groupBy(*keys).agg(F.max("last_updated").alias("last_updated"))


def latest_snapshot(
    store: DataFrame,
    data_type: str | None = None,
    how: str = "lookup",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """The newest snapshot of every (data type, symbol), or of every symbol of one type.

    ``how="lookup"`` is for stored tables. Batches usually hold a key once each, so
    dropping old payloads before a shuffle would drop nothing, and ranking would
    shuffle the whole store. Instead the newest time per key is found without payloads
    and written to the scratch folder. Its size is then known, and Spark joins it by
    broadcast if it is below ``spark.sql.autoBroadcastJoinThreshold``; all payloads but
    those of the newest time are dropped where they are read, and the few left are
    ranked. Beyond the threshold Spark joins by key and time, splitting skewed ones.

    ``how="rank"`` ranks all rows. It reads its input once and starts no job, which
    suits computed and small DataFrames. ``salts=1`` suits keys with few snapshots.
    """
    if data_type is None:
        keys = list(KEY)
    else:
        store, keys = of_type(store, data_type), ["symbol"]
    if how == "lookup":
        newest = written(newest_times(store, keys), "newest")
        # Keys whose times are all NULL have a NULL newest time, which is one to be found.
        same = [store[c].eqNullSafe(newest[c]) for c in [*keys, "last_updated"]]
        candidates = store.join(newest, same, "left_semi")
        store = candidates.select(store.columns)
    elif how != "rank":
        raise ValueError(f"unknown way to find the latest: {how!r}")
    return top_per_key(store, keys, newest_first(), 1, rank=None, salts=salts)


def nonempty_latest(
    store: DataFrame,
    data_type: str | None = None,
    how: str = "lookup",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Keys whose newest snapshot is not empty. An older snapshot never stands in for it."""
    latest = latest_snapshot(store, data_type, how, salts)
    return latest.filter(usable_flag(latest))


def usable_keys(store: DataFrame) -> DataFrame:
    """The keys of ``nonempty_latest`` without their payloads.

    Where the store says what is ``usable``, every task sends one narrow row per key, so
    even a key that is in every file costs its reducer next to nothing. Where it does
    not, only the newest payloads are looked into.
    """
    if "usable" not in store.columns:
        return nonempty_latest(store).select(*KEY)
    newest = store.groupBy(*KEY).agg(F.max(F.struct("last_updated", "id", "usable")).alias("_v"))
    return newest.filter("_v.usable").select(*KEY)


def cache_summary(store: DataFrame) -> DataFrame:
    """Newest time and number of snapshots per (data type, symbol)."""
    return store.groupBy(*KEY).agg(
        F.max("last_updated").alias("last_updated"), F.count("*").alias("data_points")
    )


def type_summary(store: DataFrame, data_type: str, key_name: str | None = None) -> DataFrame:
    """The summary of one data type, keyed by symbol (by indicator for ``economic``)."""
    if key_name is None:
        key_name = spec_for(data_type).key_name
    return (
        of_type(store, data_type)
        .groupBy(F.col("symbol").alias(key_name))
        .agg(F.max("last_updated").alias("last_updated"), F.count("*").alias("data_points"))
    )


def cached_keys(store: DataFrame, data_type: str) -> DataFrame:
    """Every symbol that has a snapshot of the type, also where the newest is empty."""
    return of_type(store, data_type).select("symbol").distinct()

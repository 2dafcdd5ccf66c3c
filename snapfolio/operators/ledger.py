"""The request ledger and the daily budget.

The ledger is a log ``endpoint, ts`` with one row per accepted request; counters
are aggregates over it and are never updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from snapfolio.catalog import DAILY_LIMIT
from snapfolio.operators.ranking import DEFAULT_SALTS, top_per_key


def request_counts(log: DataFrame) -> DataFrame:
    """Accepted requests per endpoint and day."""
    return log.groupBy("endpoint", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("count")
    )


def merge_counts(counts: DataFrame, batch: DataFrame) -> DataFrame:
    """Add the counts of a batch to stored counts."""
    return (
        counts.unionByName(batch)
        .groupBy("endpoint", "date")
        .agg(F.sum("count").alias("count"))
    )


def daily_request_total(counts: DataFrame) -> DataFrame:
    """Requests per day over all endpoints."""
    return counts.groupBy("date").agg(F.sum("count").alias("total"))


def request_total_on(counts: DataFrame, day: Column) -> DataFrame:
    """One row with the total of a day, 0 if nothing was requested on it."""
    return counts.filter(F.col("date") == day).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total")
    )


def limit_reached(totals: DataFrame, daily_limit: int = DAILY_LIMIT) -> DataFrame:
    """Whether a total uses up the budget, and what is left of it."""
    return totals.withColumn("limit_reached", F.col("total") >= daily_limit).withColumn(
        "remaining", F.greatest(daily_limit - F.col("total"), F.lit(0))
    )


def admit_within_budget(
    requests: DataFrame,
    used: DataFrame | None = None,
    daily_limit: int = DAILY_LIMIT,
    wanted: Column | None = None,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Mark in ``admitted`` the requests that the budget of their day allows.

    ``requests`` has ``request_id`` (unique) and ``ts``; ``used`` has ``date, total``
    with what was spent before. Rows that are not ``wanted`` spend nothing and are not
    admitted. Requests are admitted in the order of (ts,
    request_id) until the day's total reaches the limit. This equals deciding one
    request after the other as long as every admitted request is also accepted.

    No task ranks a whole day: only the first ``daily_limit`` requests of a day can
    be admitted, so these alone are ranked, and the last one admitted marks the cut
    that all other requests of the day are compared with. There is one cut per
    calendar day; even the whole range of a timestamp (3.7 million days) is about
    100 MB, which bounds the broadcast however many requests there are.
    """
    dated = requests.withColumn("_date", F.to_date("ts")).withColumn(
        "_wanted", F.lit(True) if wanted is None else wanted
    )
    first = top_per_key(
        dated.filter("_wanted").select("_date", "ts", "request_id"),
        ["_date"],
        [F.asc("ts"), F.asc("request_id")],
        daily_limit,
        rank="_rank",
        salts=salts,
    )
    if used is not None:
        spent = used.select(F.col("date").alias("_date"), F.col("total").alias("_used"))
        first = first.join(spent, "_date", "left").filter(
            F.col("_rank") + F.coalesce("_used", F.lit(0)) <= daily_limit
        )
    cuts = first.groupBy("_date").agg(
        F.max_by("ts", "_rank").alias("_cut_ts"),
        F.max_by("request_id", "_rank").alias("_cut_id"),
    )
    before_cut = (F.col("ts") < F.col("_cut_ts")) | (
        (F.col("ts") == F.col("_cut_ts")) & (F.col("request_id") <= F.col("_cut_id"))
    )
    return (
        dated.join(F.broadcast(cuts), "_date", "left")
        .withColumn("admitted", F.col("_wanted") & F.coalesce(before_cut, F.lit(False)))
        .drop("_date", "_wanted", "_cut_ts", "_cut_id")
    )

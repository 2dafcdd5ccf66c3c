"""Deciding for a batch of requests what to serve from the store and what to fetch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from snapfolio.catalog import CATALOG, DAILY_LIMIT
from snapfolio.functions import normalize_key
from snapfolio.operators.ranking import top_per_key
from snapfolio.operators.store import usable_keys
from snapfolio.sources.scratch import new_folder, written

#: Requests that are decided one after the other in one task, at most (or a day's budget).
BLOCK_ROWS = 1_000_000

SERVE_CACHE = "serve_cache"
FETCH = "fetch"
FALLBACK_CACHE = "fallback_cache"
UNAVAILABLE = "unavailable"


def unique_requests(requests: DataFrame) -> DataFrame:
    """One request per key and day: the earliest (lowest id among equals), a refresh if any
    of the day asked for it."""
    key = normalize_key(F.col("symbol"), F.col("data_type"))
    return (
        requests.withColumn("symbol", key)
        .filter(F.col("symbol").isNotNull())
        .groupBy("data_type", "symbol", F.to_date("ts").alias("_day"))
        .agg(
            F.min(F.struct("ts", "request_id")).alias("_first"),
            F.max("refresh").alias("refresh"),
        )
        .select("data_type", "symbol", "_first.request_id", "_first.ts", "refresh")
    )


def _numbered_days(requests: DataFrame, used: DataFrame | None, daily_limit: int, block: int) -> DataFrame:
    """The days of the requests: their block, their place in it, and what is left of their budget. There is
    a row per calendar day, however many requests there are."""
    days = requests.select("_day").filter("_day IS NOT NULL").distinct()
    number = F.row_number().over(Window.orderBy("_day")) - 1
    days = days.withColumn("_n", number).select(
        "_day", F.floor(F.col("_n") / block).cast("int").alias("_block"), (F.col("_n") % block).alias("_place")
    )
    if used is None:
        return days.withColumn("_left", F.lit(daily_limit).cast("long"))
    spent = used.select(F.col("date").alias("_day"), F.col("total").alias("_used"))
    left = F.lit(daily_limit) - F.coalesce("_used", F.lit(0))
    return days.join(spent, "_day", "left").withColumn("_left", left.cast("long")).drop("_used")


def _walked(candidates: DataFrame) -> DataFrame:
    """``_place, _rank`` of the candidates of one block that are fetched, decided one after the other.

    The block is a group of bounded size, see ``days_per_block``.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_place", "_rank"])
        fetched: set[tuple[str, str]] = set()
        admitted, place, left = [], -1, 0
        for at, rank, budget, refresh, data_type, symbol in zip(
            rows["_place"], rows["_rank"], rows["_left"], rows["refresh"], rows["data_type"], rows["symbol"],
            strict=True,
        ):
            if at != place:
                place, left = at, budget
            if left > 0 and (refresh or (data_type, symbol) not in fetched):
                left -= 1
                fetched.add((data_type, symbol))
                admitted.append((at, rank))
        return pd.DataFrame(admitted, columns=["_place", "_rank"])

    columns = ["_place", "_rank", "_left", "refresh", "data_type", "symbol"]
    return candidates.select("_block", *columns).groupBy("_block").applyInPandas(walk, "_place INT, _rank INT")


def days_per_block(daily_limit: int, most_rows: int = BLOCK_ROWS) -> int:
    """How many days are decided at once. Of day number j of a block no more than ``j * daily_limit`` requests can
    be decided otherwise because of the block's days before it, so the first ``(j + 1) * daily_limit`` are
    enough; together they are at most ``most_rows``, or those of one day. Spark cuts them before it shuffles
    if there are no more a day than ``windowGroupLimitThreshold``."""
    days = 1
    while max(daily_limit, 1) * (days + 1) * (days + 2) // 2 <= most_rows:
        days += 1
    return days


def _fetches(known: DataFrame, days: DataFrame, daily_limit: int, block: int) -> DataFrame:
    """``_day, ts, request_id, data_type, symbol`` of all requests that are fetched.

    Of a key that is not cached, a day's first request wants to be fetched, and of every key those that ask for a refresh. (If
    the first is denied the budget is spent, and later ones are denied as well; if it is not, they find the key
    cached.) Block by block, the first candidates of each day are taken whose keys no block before has fetched,
    and are decided in order.
    """
    spark = known.sparkSession
    dated = known.join(days.filter("_left > 0"), "_day")
    first = (
        dated.filter(~F.col("cached"))
        .groupBy("_block", "_place", "_left", "_day", "data_type", "symbol")
        .agg(F.min(F.struct("ts", "request_id", "refresh")).alias("_first"))
        .select("_block", "_place", "_left", "_day", "data_type", "symbol", "_first.*")
        .filter(~F.col("refresh"))
    )
    again = dated.filter("refresh").select(first.columns)
    path = new_folder(spark, "candidates")
    first.unionByName(again).write.partitionBy("_block").parquet(path)
    candidates = spark.read.schema(first.schema).parquet(path)
    columns = ["_day", "ts", "request_id", "data_type", "symbol"]
    fetched = spark.createDataFrame([], known.select(columns).schema)
    blocks = days.agg(F.max("_block")).first()[0]
    for number in range(0 if blocks is None else blocks + 1):
        rows = candidates.filter(F.col("_block") == number)
        if number:
            keys = fetched.select(F.col("data_type").alias("_t"), F.col("symbol").alias("_s")).distinct()
            same = (F.col("data_type") == F.col("_t")) & (F.col("symbol") == F.col("_s")) & ~F.col("refresh")
            rows = rows.join(keys, same, "left_anti")
        ranked = top_per_key(
            rows, ["_place"], [F.asc("ts"), F.asc("request_id")], daily_limit * block, rank="_rank"
        ).filter(F.col("_rank") <= (F.col("_place") + 1) * daily_limit)
        ranked = written(ranked, "ranked")
        now = ranked.join(_walked(ranked), ["_place", "_rank"]).select(columns)
        fetched = fetched.unionByName(written(now, "fetched"))
    return fetched


def plan_requests(
    requests: DataFrame,
    store: DataFrame,
    used: DataFrame | None = None,
    daily_limit: int = DAILY_LIMIT,
    once_a_day: bool = True,
    block: int | None = None,
) -> DataFrame:
    """Add a ``decision`` to every request, as if they came one after the other in the order of (ts, request_id).

    ``requests`` has ``request_id`` (unique), ``ts, data_type, symbol, refresh``. A usable snapshot
    is served unless a refresh was asked for. Everything else is fetched while the
    day's budget lasts; beyond it a usable snapshot is the fallback. What is fetched is usable from then on:
    later requests for its key, of the same day or later ones, are served from it. With ``once_a_day`` the requests for a key on
    one day count as one (see ``unique_requests``), else each is decided.

    At most ``daily_limit`` requests a day are fetched, so what one day changes for later ones is small. Which requests
    are fetched is found for many days in one job from a bounded number of candidates (``days_per_block``), so
    there are as many jobs as blocks of days, whatever the number of requests. Every other decision follows from two
    small tables: when a key was fetched first, and the last request that a day's budget was spent on.

    Rows without a key are dropped; rows without a time are neither fetched nor served from what is fetched here.
    """
    if block is None:
        cut = int(store.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
        block = min(days_per_block(daily_limit), max(1, cut // max(daily_limit, 1)))
    if once_a_day:
        rows = unique_requests(requests)
    else:
        key = normalize_key(F.col("symbol"), F.col("data_type"))
        rows = requests.withColumn("symbol", key).filter(F.col("symbol").isNotNull())
    cached = usable_keys(store).withColumn("cached", F.lit(True))
    known = written(
        rows.select("request_id", "ts", "data_type", "symbol", F.coalesce("refresh", F.lit(False)).alias("refresh"))
        .join(cached, ["data_type", "symbol"], "left")
        .withColumn("cached", F.coalesce("cached", F.lit(False)))
        .withColumn("_day", F.to_date("ts")),
        "known",
    )
    days = written(_numbered_days(known, used, daily_limit, block), "days")
    fetched = _fetches(known, days, daily_limit, block)
    since = fetched.groupBy("data_type", "symbol").agg(F.min(F.struct("ts", "request_id")).alias("_since"))
    spent = fetched.groupBy("_day").agg(
        F.count("*").alias("_fetched"), F.max(F.struct("ts", "request_id")).alias("_last")
    )
    budgets = days.join(spent, "_day", "left").select(
        "_day",
        (F.col("_left") > 0).alias("_open"),
        # Unless the budget is spent, nothing comes after its last request.
        F.when(F.col("_fetched") >= F.col("_left"), F.col("_last")).alias("_last"),
    )
    now = F.struct("ts", "request_id")
    usable = F.col("cached") | F.coalesce(F.col("_since") < now, F.lit(False))
    wants = ~F.col("_usable") | F.col("refresh")
    admitted = F.coalesce(F.col("_open") & (F.col("_last").isNull() | (now <= F.col("_last"))), F.lit(False))
    decision = (
        F.when(~wants, SERVE_CACHE)
        .when(admitted, FETCH)
        .when(F.col("_usable"), FALLBACK_CACHE)
        .otherwise(UNAVAILABLE)
    )
    return (
        known.join(since, ["data_type", "symbol"], "left")
        .join(budgets, "_day", "left")
        .withColumn("_usable", usable)
        .withColumn("decision", decision)
        .select("request_id", "ts", "data_type", "symbol", "refresh", "decision")
    )


def request_path(plan: DataFrame) -> DataFrame:
    """Add ``endpoint`` and the relative ``path`` to request for every row."""
    pairs = [(F.lit(s.data_type), F.lit(s.path), F.lit(s.request)) for s in CATALOG]
    endpoints = F.create_map(*[c for t, p, _ in pairs for c in (t, p)])
    forms = F.create_map(*[c for t, _, r in pairs for c in (t, r)])
    form = F.element_at(forms, F.col("data_type"))
    return plan.withColumn("endpoint", F.element_at(endpoints, F.col("data_type"))).withColumn(
        "path", F.concat("endpoint", F.replace(form, F.lit("{key}"), F.col("symbol")))
    )

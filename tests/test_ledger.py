"""Counters, budget and planning."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snapfolio.operators import ledger, planning


def _log(spark, n, day="2024-01-01", endpoint="/v3/ratios"):
    return spark.range(n).select(
        F.lit(endpoint).alias("endpoint"), F.lit(day).cast("timestamp_ntz").alias("ts")
    )


@pytest.mark.parametrize("n, reached, left", [(249, False, 1), (250, True, 0), (251, True, 0)])
def test_limit(spark, n, reached, left):
    half = n // 2
    log = _log(spark, half).union(_log(spark, n - half, endpoint="/v3/grades"))
    totals = ledger.daily_request_total(ledger.request_counts(log))
    assert ledger.limit_reached(totals).collect() == [(date(2024, 1, 1), n, reached, left)]


def test_day_without_requests(spark):
    counts = ledger.request_counts(_log(spark, 3))
    totals = [
        ledger.request_total_on(counts, F.lit(day).cast("date")).first()["total"]
        for day in ("2024-01-01", "2024-01-02")
    ]
    assert totals == [3, 0]
    empty = ledger.request_total_on(counts, F.lit("2024-01-02").cast("date"))
    assert ledger.limit_reached(empty).collect() == [(0, False, 250)]


def test_merge_counts(spark, rows):
    a = ledger.request_counts(_log(spark, 2))
    b = ledger.request_counts(_log(spark, 3).union(_log(spark, 1, day="2024-01-02")))
    assert rows(ledger.merge_counts(a, b)) == [
        ("/v3/ratios", date(2024, 1, 1), 5), ("/v3/ratios", date(2024, 1, 2), 1),
    ]


def _requests(spark, ids_and_days):
    return spark.createDataFrame(ids_and_days, "request_id BIGINT, day STRING").select(
        "request_id", F.col("day").cast("timestamp_ntz").alias("ts")
    )


@pytest.mark.parametrize("salts", [1, 32])
def test_admission_is_in_order(spark, rows, salts):
    requests = _requests(
        spark, [(5, "2024-01-01 10:00"), (4, "2024-01-01 10:00"), (1, "2024-01-01 11:00"),
                (2, "2024-01-02"), (3, "2024-01-01 09:00"), (6, "2024-01-03")],
    )
    used = spark.createDataFrame([(date(2024, 1, 2), 3), (date(2024, 1, 1), 1)], "date DATE, total BIGINT")
    admitted = ledger.admit_within_budget(requests, used, daily_limit=3, salts=salts)
    assert rows(admitted.filter("admitted").select("request_id")) == [(3,), (4,), (6,)]
    assert admitted.count() == 6
    unlimited = ledger.admit_within_budget(requests, daily_limit=3, salts=salts)
    assert rows(unlimited.filter("NOT admitted").select("request_id")) == [(1,)]


def test_a_day_with_many_requests(spark):
    """Compared with admitting one after the other."""
    requests = spark.range(20_000, numPartitions=8).select(
        F.col("id").alias("request_id"),
        F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(id % 3, 0, 0, (id * 7919) % 86400)").alias("ts"),
    )
    admitted = ledger.admit_within_budget(requests).filter("admitted")
    expected, spent = set(), {}
    for r in sorted(requests.collect(), key=lambda r: (r["ts"], r["request_id"])):
        day = r["ts"].date()
        if spent.get(day, 0) < 250:
            spent[day] = spent.get(day, 0) + 1
            expected.add(r["request_id"])
    assert {r["request_id"] for r in admitted.collect()} == expected


def _plan_by_hand(requests, cached, used, limit, once_a_day):
    """One request after the other. What is fetched is cached for all that come later."""
    if once_a_day:
        keys = {}
        for rid, ts, data_type, symbol, refresh in requests:
            key = (data_type, symbol.strip().upper(), ts.date())
            old = keys.get(key, (rid, ts, False))
            first = min((old[1], old[0]), (ts, rid))
            keys[key] = (first[1], first[0], old[2] or refresh)
        requests = [(rid, ts, key[0], key[1], refresh) for key, (rid, ts, refresh) in keys.items()]
    plan, spent, cached = {}, dict(used), set(cached)
    for rid, ts, data_type, symbol, refresh in sorted(requests, key=lambda r: (r[1], r[0])):
        key = (data_type, symbol.strip().upper())
        if not key[1]:
            continue
        if key in cached and not refresh:
            plan[rid] = "serve_cache"
        elif spent.get(ts.date(), 0) < limit:
            spent[ts.date()] = spent.get(ts.date(), 0) + 1
            cached.add(key)
            plan[rid] = "fetch"
        else:
            plan[rid] = "fallback_cache" if key in cached else "unavailable"
    return plan


REQUEST_DDL = "request_id BIGINT, ts TIMESTAMP_NTZ, data_type STRING, symbol STRING, refresh BOOLEAN"


@pytest.mark.parametrize("once_a_day", [True, False])
@pytest.mark.parametrize("block", [None, 1, 3])
def test_plan_matches_deciding_one_by_one(spark, store_of, once_a_day, block):
    requests = [
        (i, datetime(2024, 1, 1 + i % 7) + timedelta(minutes=(i * 37) % 600), ("price", "news")[i % 2],
         f" s{(i * 7) % 41} " if i % 29 else "  ", i % 5 == 0)
        for i in range(400)
    ]
    snapshots = [(i, ("price", "news")[i % 2], f"S{i}", "2024-01-01", "[1]") for i in range(12)]
    # The newest snapshot of one key is empty, so it is not usable.
    snapshots.append((99, "price", "S4", "2024-01-02", "[]"))
    cached = {(t, s) for _, t, s, _, _ in snapshots} - {("price", "S4")}
    # Of one day nothing is left, of one it is less than nothing.
    used = {date(2024, 1, 1): 3, date(2024, 1, 4): 9, date(2024, 1, 5): 12}
    plan = planning.plan_requests(
        spark.createDataFrame(requests, REQUEST_DDL), store_of(*snapshots),
        spark.createDataFrame(list(used.items()), "date DATE, total BIGINT"),
        daily_limit=9, once_a_day=once_a_day, block=block,
    )
    got = {r["request_id"]: r["decision"] for r in plan.collect()}
    expected = _plan_by_hand(requests, cached, used, 9, once_a_day)
    assert got == expected
    assert set(expected.values()) == {"serve_cache", "fetch", "fallback_cache", "unavailable"}


def test_what_was_fetched_is_served_on_later_days(spark, store_of):
    wanted = [(i, datetime(2024, 1, 1 + i), "price", "AAPL", False) for i in range(3)]
    wanted += [(9, datetime(2024, 1, 3, 12), "price", "AAPL", True), (10, None, "price", "AAPL", None)]
    plan = planning.plan_requests(
        spark.createDataFrame(wanted, REQUEST_DDL), store_of(), once_a_day=False
    )
    assert {r["request_id"]: r["decision"] for r in plan.collect()} == {
        0: "fetch", 1: "serve_cache", 2: "serve_cache", 9: "fetch", 10: "unavailable",
    }
    none = planning.plan_requests(spark.createDataFrame([], REQUEST_DDL), store_of())
    assert none.collect() == []


def test_a_refresh_may_come_before_the_first_plain_request(spark, store_of):
    """Plain requests that a refresh of the same day has served must not use up the candidates."""
    wanted = [(i, datetime(2024, 1, 1), "price", f"S{i % 3}", i < 3) for i in range(30)]
    wanted += [(100 + i, datetime(2024, 1, 1, 5), "price", f"T{i}", False) for i in range(6)]
    plan = planning.plan_requests(
        spark.createDataFrame(wanted, REQUEST_DDL), store_of(), daily_limit=5, once_a_day=False
    )
    got = {r["request_id"]: r["decision"] for r in plan.collect()}
    assert got == _plan_by_hand(wanted, set(), {}, 5, False)


def test_blocks_of_days_are_bounded():
    for limit in (1, 250, 10_000, 5_000_000):
        days = planning.days_per_block(limit)
        assert days == 1 or limit * days * (days + 1) // 2 <= planning.BLOCK_ROWS


def test_request_paths(spark, rows):
    plan = spark.createDataFrame(
        [("price", "AAPL"), ("economic", "gdp"), ("news", "A"), ("esg", "B")], "data_type STRING, symbol STRING"
    )
    assert rows(planning.request_path(plan).select("path")) == [
        ("/v3/economic?name=gdp",), ("/v3/historical-price-full/AAPL",),
        ("/v3/stock_news?tickers=A&limit=50",),
        ("/v4/esg-environmental-social-governance-data?symbol=B",),
    ]

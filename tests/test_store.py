"""Latest snapshots, summaries and views on hand-made stores."""

import json

import pytest
from pyspark.sql import functions as F

from snapfolio.catalog import CATALOG, spec_for
from snapfolio.operators import store
from snapfolio.operators.ranking import top_per_key
from snapfolio.operators.shaping import explode_records, flatten_nested_map, record_totals
from snapfolio.plans.views import dataset_view, view_totals
from snapfolio.sources import store_table
from snapfolio.sources.scratch import new_folder

WAYS = [("lookup", 32), ("rank", 32), ("rank", 1)]


@pytest.mark.parametrize("how, salts", WAYS)
def test_latest_is_newest_then_last_inserted(store_of, rows, how, salts):
    df = store_of(
        (1, "price", "A", "2024-01-02", "old id"),
        (2, "price", "A", "2024-01-02", "new id"),
        (3, "price", "A", "2024-01-01", "old day"),
        (4, "news", "A", "2023-01-01", "other type"),
    )
    latest = store.latest_snapshot(df, how=how, salts=salts)
    assert latest.columns == df.columns
    assert rows(latest.select("data_type", "raw_data")) == [
        ("news", "other type"), ("price", "new id"),
    ]
    one = store.latest_snapshot(df, "price", how=how, salts=salts)
    assert rows(one.select("raw_data")) == [("new id",)]


@pytest.mark.parametrize("how, salts", WAYS)
def test_a_row_that_landed_twice_is_one_latest(store_of, how, salts):
    row = (1, "price", "A", "2024-01-02", "[1]")
    assert store.latest_snapshot(store_of(row, row), how=how, salts=salts).count() == 1


@pytest.mark.parametrize("how, salts", WAYS)
@pytest.mark.parametrize("flagged", [False, True])
def test_empty_latest_hides_older_ones(store_of, rows, how, salts, flagged):
    df = store_of(
        (1, "price", "A", "2024-01-01", '[{"date":"x"}]'),
        (2, "price", "A", "2024-01-02", "[]"),
        (3, "price", "B", "2024-01-01", "[]"),
        (4, "price", "B", "2024-01-02", '[{"date":"y"}]'),
        (5, "outlook", "C", "2024-01-02", "{}"),
        (6, "outlook", "D", "2024-01-02", "null"),
        (7, "outlook", "E", "2024-01-02", "[1,"),
    )
    if flagged:
        df = df.withColumn("usable", F.col("id").isin(1, 4))
    assert rows(store.nonempty_latest(df, how=how, salts=salts).select("id")) == [(4,)]
    assert rows(store.usable_keys(df)) == [("price", "B")]
    # It still counts in the summaries.
    assert rows(store.cached_keys(df, "price")) == [("A",), ("B",)]
    assert rows(store.type_summary(df, "price").select("symbol", "data_points")) == [("A", 2), ("B", 2)]


def test_indicator_summary(store_of):
    df = store_of((1, "economic", "gdp", "2024-01-01", "[]"))
    assert store.type_summary(df, "economic").columns == ["indicator", "last_updated", "data_points"]


@pytest.mark.parametrize("salts", [1, 2, 32])
def test_hot_key(spark, salts):
    """A third of all rows has one key."""
    df = spark.range(30_000, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("key"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id",
    )
    top = top_per_key(df, ["key"], [F.desc("v"), F.asc("id")], 10, salts=salts)
    expected = {}
    for key, v, i in df.collect():
        expected.setdefault(key, []).append((-v, i))
    got = {(r["key"], r["rank"]): r["id"] for r in top.collect()}
    assert got == {
        (key, n + 1): i for key, vs in expected.items() for n, (_, i) in enumerate(sorted(vs)[:10])
    }


def _view(store_of, data_type, payload, how="rank"):
    raw = payload if isinstance(payload, str) else json.dumps(payload)
    df = store_of((1, data_type, "A", "2024-01-01", raw))
    view = dataset_view(df, spec_for(data_type), how=how)
    return [r.asDict() for r in view.orderBy("rank").collect()], view.columns


WRONG_SHAPES = ["[]", '{"Error Message":"x"}', "oops", "5", "[1,2]", '[{"date":"x"},2]', "null", '"text"', "{}"]


@pytest.mark.parametrize("spec", CATALOG, ids=lambda s: s.data_type)
def test_schema_is_fixed_and_wrong_shapes_give_no_rows(store_of, spec):
    df = store_of(*[(i, spec.data_type, f"S{i}", "2024-01-01", p) for i, p in enumerate(WRONG_SHAPES)])
    view = dataset_view(df, spec, how="rank", salts=1)
    lead = ["symbol", "rank"] if spec.data_type == "revenue" else ["symbol", "rank", "pos"]
    assert view.columns == lead + [f.label for f in spec.fields]
    assert view.collect() == []


def test_missing_keys_and_null_dates(store_of):
    found, _ = _view(store_of, "price", [
        {"date": None, "open": 1}, {"date": "2024-01-02", "open": 2, "extra": [1]}, {"open": 3},
        {"date": "2024-01-03"}, {"date": "2024-01-02", "open": 5},
    ])
    assert [(r["rank"], r["pos"], r["Date"], r["Open"]) for r in found] == [
        (1, 3, "2024-01-03", None), (2, 1, "2024-01-02", 2.0), (3, 4, "2024-01-02", 5.0),
        (4, 0, None, 1.0), (5, 2, None, 3.0),
    ]
    assert {r["Close"] for r in found} == {None}


def test_present_but_null_is_shown_and_absent_is_not(store_of):
    assert len(_view(store_of, "price", [{"date": None}, {"foo": 1}])[0]) == 2
    assert _view(store_of, "price", [{"foo": 1}, {"bar": None}])[0] == []
    assert _view(store_of, "price", [{}])[0] == []
    assert _view(store_of, "price", [None])[0] == []


@pytest.mark.parametrize("n, truncated", [(9, False), (10, False), (11, True)])
def test_ten_rows(store_of, n, truncated):
    payload = json.dumps([{"date": f"2024-01-{d:02}"} for d in range(1, n + 1)])
    df = store_of((1, "price", "A", "2024-01-01", payload))
    spec = spec_for("price")
    view = dataset_view(df, spec)
    assert view.count() == min(n, 10)
    assert view.filter("rank = 1").first()["Date"] == f"2024-01-{n:02}"
    assert view_totals(df, spec).collect() == [("A", n, truncated)]
    assert record_totals(explode_records(df, spec)).collect() == [("A", n, truncated)]


def test_profile_shows_all_rows(store_of):
    found, _ = _view(store_of, "profile", [{"price": i} for i in range(12)])
    assert [r["Price"] for r in found] == [float(i) for i in range(12)]


def test_holders_keep_payload_order(store_of):
    found, _ = _view(store_of, "holders", [{"dateReported": d} for d in ("b", "c", "a")])
    assert [(r["pos"], r["Date"]) for r in found] == [(0, "b"), (1, "c"), (2, "a")]


def test_outlook(store_of):
    found, _ = _view(store_of, "outlook", {"profile": {"companyName": "x", "beta": 1}, "metrics": {}})
    assert [(r["Company"], r["Beta"], r["Price"]) for r in found] == [("x", 1.0, None)]
    for payload in ({"metrics": {}}, {"profile": {}}, {"profile": None}, {"profile": {"foo": 1}}):
        assert _view(store_of, "outlook", payload)[0] == []
    assert len(_view(store_of, "outlook", {"profile": {"price": None}})[0]) == 1


def test_revenue(store_of):
    payload = {"breakdown": {"2022": {"B": 1}, "2023": {"B": None, "A": 2.5}, "2021": {}, "2020": None}}
    found, _ = _view(store_of, "revenue", payload)
    assert [(r["rank"], r["Period"], r["Segment"], r["Revenue"]) for r in found] == [
        (1, "2023", "A", 2.5), (2, "2023", "B", None), (3, "2022", "B", 1.0),
    ]
    assert _view(store_of, "revenue", {"breakdown": {}})[0] == []


def test_flatten_keeps_null_values(store_of, rows):
    df = store_of((1, "revenue", "A", "2024-01-01", '{"breakdown":{"2023":{"A":null}}}'))
    assert rows(flatten_nested_map(df, "breakdown")) == [("A", "2023", "A", None)]


def test_table_round_trip(spark, store_of, rows):
    df = store_of(
        (1, "price", "A", "2024-01-01", '[{"date":"x"}]'), (2, "news", "B", "2024-01-02", "[]"),
    )
    path = new_folder(spark, "test-store")
    store_table.append_snapshot(df, path)
    store_table.append_snapshot(df.withColumn("id", F.col("id") + 10), path)
    table = store_table.scan_snapshots(spark, path)
    assert rows(table.select("id", "data_type", "usable")) == [
        (1, "price", True), (2, "news", False), (11, "price", True), (12, "news", False),
    ]
    assert rows(store_table.scan_snapshots(spark, path, "news").select("id")) == [(2,), (12,)]
    assert rows(store.latest_snapshot(table).select("id")) == [(11,), (12,)]
    # A second append on the same day ties on time: the later id wins.
    assert rows(store.nonempty_latest(table).select("id")) == [(11,)]

"""Exports written and read back."""

import csv
import glob
import io
import json

import pytest
from pyspark.sql import functions as F

from snapfolio.catalog import CATALOG, spec_for
from snapfolio.sources import export
from snapfolio.sources.scratch import new_folder

TEXTS = ['plain', 'a "quoted", text', "two\nlines", "", None, "é ,;|", "\\", 'ends with \\"']


def _news(store_of):
    payload = json.dumps([{"publishedDate": f"2024-01-{i + 1:02}", "title": t, "site": "x"} for i, t in enumerate(TEXTS)])
    return store_of(
        (1, "news", "A", "2024-01-01", payload),
        (2, "news", "B", "2024-01-01", "[]"),
        (3, "news", "C", "2024-01-01", '[{"title":"only"}]'),
        (4, "news", "C", "2023-01-01", '[{"title":"old"}]'),
    )


def test_csv_read_by_other_readers(spark, store_of):
    path = new_folder(spark, "test-csv")
    export.export_csv(export.export_records(_news(store_of), spec_for("news")), path)
    found = []
    for name in glob.glob(f"{path}/*.csv"):
        with open(name, newline="", encoding="utf-8") as f:
            found += list(csv.DictReader(io.StringIO(f.read(), newline="")))
    assert [r["title"] for r in sorted(found, key=lambda r: (r["symbol"], int(r["pos"]))) if r["symbol"] == "A"] == [
        t or "" for t in TEXTS
    ]
    assert {r["symbol"] for r in found} == {"A", "C"}
    schema = "symbol STRING, pos BIGINT, publishedDate STRING, title STRING, site STRING"
    again = spark.read.options(**export.CSV_OPTIONS).schema(schema).csv(path)
    assert {r["title"] for r in again.filter("symbol = 'A'").collect()} >= {t for t in TEXTS if t}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_all_symbols_in_one_job(spark, store_of, fmt):
    folder = new_folder(spark, "test-exports")
    path = export.export_all_keys(_news(store_of), spec_for("news"), folder, "20240601_120000", fmt=fmt)
    assert path == f"{folder}/news/run=20240601_120000"
    # One folder and one file per symbol; the symbol with an empty newest snapshot has none.
    assert sorted(p.split("symbol=")[1][0] for p in glob.glob(f"{path}/symbol=*/part-*")) == ["A", "C"]


def test_existing_export_is_not_overwritten(spark, store_of):
    folder = new_folder(spark, "test-exports")
    run = dict(directory=folder, run="1", layout="flat")
    export.export_all_keys(_news(store_of), spec_for("news"), **run)
    with pytest.raises(Exception, match="(?i)already exists"):
        export.export_all_keys(_news(store_of), spec_for("news"), **run)


@pytest.mark.parametrize("how", ["lookup", "rank"])
def test_chosen_symbols(spark, store_of, rows, how):
    spec, df = spec_for("news"), _news(store_of)
    chosen = export.export_records(df, spec, keys=["C", "missing"], how=how)
    assert rows(chosen.select("symbol", "title")) == [("C", "only")]
    keys = spark.createDataFrame([("C",), ("C",), ("missing",)], "symbol STRING")
    chosen = export.export_records(df, spec, keys=keys, how=how)
    assert rows(chosen.select("symbol", "title")) == [("C", "only")]


def test_other_payload_keys(store_of, rows):
    spec = spec_for("ratios")
    df = store_of(
        (1, "ratios", "A", "2024-01-01", '[{"date":"x","zeta":1,"nested":{"a":[1]}},{"date":"y","alpha beta":"t"}]'),
        (2, "ratios", "B", "2024-01-01", '{"Error Message":"ignored"}'),
    )
    ddl = export.infer_record_type(df, spec)
    records = export.export_records(df, spec, record_ddl=ddl)
    assert records.columns == ["symbol", "pos", *spec.keys, "alpha beta", "nested", "zeta"]
    assert rows(records.select("pos", "date", "alpha beta", "zeta")) == [
        (0, "x", None, 1), (1, "y", "t", None),
    ]
    assert records.filter("pos = 0").select(F.to_json("nested")).first()[0] == '{"a":[1]}'


def test_whole_payloads_by_default(spark, store_of):
    """Undeclared keys, also such as clash, numbers as text, nested values and blanks."""
    spec = spec_for("ratios")
    first = {
        "symbol": "own", "pos": "p", "date": "x", "Date": "twin", "currentRatio": "1.5", "VOIDED": 1, "VARIANT_ID": "v",
        "nested": {"a": [1, {"b": None}]}, "padded": "  lead and trail  ", "": "no name", "a.b`c": True,
    }
    df = store_of(
        (1, "ratios", "A", "2024-01-01", json.dumps([first, {"symbol_2": "z"}])),
        (2, "ratios", "B", "2024-01-01", '{"Error Message":"ignored"}'),
        (3, "ratios", "C", "2024-01-01", '[{"currentRatio":2,"voided":null}]'),
    )
    records = export.export_records(df, spec, typed=False)
    others = ["_", "Date_2", "VARIANT_ID", "VOIDED", "a.b`c", "nested", "padded", "pos_2", "symbol_2", "symbol_2_2", "voided_2"]
    assert records.columns == ["symbol", "pos", *spec.keys, *others]
    found = [r.asDict() for r in records.orderBy("symbol", "pos").collect()]
    assert [(r["symbol"], r["pos"], r["currentRatio"]) for r in found] == [("A", 0, 1.5), ("A", 1, None), ("C", 0, 2.0)]
    assert [found[0][c] for c in others] == [
        "no name", "twin", "v", "1", "true", '{"a":[1,{"b":null}]}', "  lead and trail  ", "p", "own", None, None,
    ]
    assert found[1]["symbol_2_2"] == "z"
    path = new_folder(spark, "test-csv")
    export.export_csv(records, path)
    again = spark.read.options(**export.CSV_OPTIONS).csv(path).filter("symbol = 'A' AND pos = 0").first()
    assert (again["padded"], again["VOIDED"]) == ("  lead and trail  ", "1")
    assert export.export_records(df, spec, only_declared=True).columns == ["symbol", "pos", *spec.keys]
    none = export.export_records(df.filter("symbol = 'none'"), spec)
    assert none.columns == ["symbol", "pos", *spec.keys] and none.collect() == []


def test_other_members_of_an_outlook(store_of):
    body = '{"profile":{"companyName":"x","symbol":"A"},"metrics":{"pe":[1]},"ratios":[],"price":3}'
    records = export.export_records(store_of((1, "outlook", "A", "2024-01-01", body)), spec_for("outlook"), typed=False)
    row = records.first().asDict()
    assert (row["companyName"], row["symbol_2"], row["price"]) == ("x", "A", None)
    assert (row["metrics"], row["ratios"], row["price_2"]) == ('{"pe":[1]}', "[]", "3")


def test_nested_columns_as_json_text(spark, store_of):
    spec, path = spec_for("ratios"), new_folder(spark, "test-csv")
    df = store_of((1, "ratios", "A", "2024-01-01", '[{"date":"x","nested":{"a":[1,2]}}]'))
    export.export_csv(
        export.export_records(df, spec, record_ddl=export.infer_record_type(df, spec)), path
    )
    assert spark.read.options(**export.CSV_OPTIONS).csv(path).first()["nested"] == '{"a":[1,2]}'


def test_outlook_and_revenue_are_flattened(store_of, rows):
    df = store_of(
        (1, "outlook", "A", "2024-01-01", '{"profile":{"companyName":"x","ceo":"y"}}'),
        (2, "outlook", "B", "2024-01-01", '{"metrics":{}}'),
        (3, "revenue", "A", "2024-01-01", '{"breakdown":{"2023":{"p":1,"q":null}}}'),
    )
    spec = spec_for("outlook")
    assert rows(export.export_records(df, spec).select("symbol", "companyName")) == [("A", "x")]
    ddl = export.infer_record_type(df, spec)
    assert rows(export.export_records(df, spec, record_ddl=ddl).select("companyName", "ceo")) == [("x", "y")]
    revenue = export.export_records(df, spec_for("revenue")).filter("value IS NOT NULL")
    assert revenue.collect() == [("A", "2023", "p", 1.0)]


def test_targets(spark, rows):
    symbols = spark.createDataFrame([("AAPL",)], "symbol STRING")
    for spec in CATALOG:
        base, target = export.export_targets(symbols, spec, "out/", "1").first()[1:]
        assert base == f"AAPL_{spec.export_suffix}_1"
        assert target == f"out/{spec.data_type}/run=1/symbol=AAPL"


def test_types_of_undeclared_keys(store_of):
    """Beside keys that clash or are odd, and payloads that have no exact variant."""
    bodies = [
        [{"date": "x", "n": 1, "N": "one", "f": 1, "b": True, "mixed": 1, "none": None, "": 5, "a.b`c": 2.5, "big": 2**70, "text": "7"}],
        [{"f": 2.25, "n": -3, "mixed": "t", "b": False, "nested": {"a": 1}, "symbol": 4, "some": None}, {"n": None, "some": [1]}],
    ]
    df = store_of(*[(i, "ratios", f"S{i}", "2024-01-01", json.dumps(b)) for i, b in enumerate(bodies)])
    records = export.export_records(df, spec_for("ratios"))
    types = dict(records.dtypes)
    expected = {
        "n": "bigint", "N_2": None, "f": "double", "b": "boolean", "mixed": "string", "none": "string", "_": "bigint",
        "a.b`c": "double", "big": "string", "text": "string", "nested": "string", "symbol_2": "bigint", "some": "string",
    }
    # Keys go by name, capitals first, so the later of two that clash gets a number.
    expected = {"N": "string", "n_2": "bigint"} | {k: v for k, v in expected.items() if k not in ("n", "N_2")}
    assert {k: types[k] for k in expected} == expected
    rows = {(r["symbol"], r["pos"]): r.asDict() for r in records.collect()}
    first, second, third = rows["S0", 0], rows["S1", 0], rows["S1", 1]
    assert (first["n_2"], first["f"], first["b"], first["_"], first["a.b`c"], first["mixed"]) == (1, 1.0, True, 5, 2.5, "1")
    assert (first["big"], first["text"], second["f"], second["mixed"]) == (str(2**70), "7", 2.25, "t")
    assert (second["nested"], second["symbol_2"], third["n_2"], third["some"]) == ('{"a":1}', 4, None, "[1]")
    repeated = store_of((9, "ratios", "T", "2024-01-01", '[{"k":1,"o":{"x":1,"x":2}}]'))
    assert dict(export.export_records(repeated, spec_for("ratios")).dtypes)["k"] == "string"


def test_types_of_an_outlooks_other_members(store_of):
    body = '{"profile":{"companyName":"x","employees":12},"price":3,"beta":1.5,"metrics":{"pe":[1]}}'
    records = export.export_records(store_of((1, "outlook", "A", "2024-01-01", body)), spec_for("outlook"))
    types, row = dict(records.dtypes), records.first().asDict()
    assert (types["employees"], row["employees"]) == ("bigint", 12)
    found = {k: v for k, v in row.items() if v in (3, 1.5)}
    assert sorted(found.values()) == [1.5, 3]


SYMBOLS = ["^GSPC", "BRK/B", "A=B", "50%", "EUR:USD", "plain", "é x", "a_ratios_1", "{}[]*?"]


def test_a_file_per_symbol_under_its_own_name(spark, store_of):
    spec, folder = spec_for("grades"), new_folder(spark, "test-exports")
    store = store_of(*[(i, "grades", s, "2024-01-01", f'[{{"date":"d{i}"}},{{"date":"e"}}]') for i, s in enumerate(SYMBOLS)])
    run = dict(directory=folder, run="20240601_120000", layout="file")
    path = export.export_all_keys(store, spec, **run)
    targets = {r["symbol"]: r["target"] for r in export.named_targets(store, spec, folder, "20240601_120000").collect()}
    listed = {r["symbol"]: f"{path}/{r['file']}" for r in export.exported_files(spark, path).collect()}
    assert targets == listed and set(targets) == set(SYMBOLS)
    schema = "pos BIGINT, date STRING"
    read = spark.read.options(**export.CSV_OPTIONS).schema(schema).csv(path)
    rows = read.select("date", F.url_decode("_metadata.file_path").alias("f")).filter("date <> 'e'").collect()
    strip = lambda name: name.removeprefix("file:").replace("//", "/")
    assert {strip(r["f"]): r["date"] for r in rows} == {
        strip(targets[s]): f"d{i}" for i, s in enumerate(SYMBOLS)
    }
    assert "/%5EGSPC_" in targets["^GSPC"] and "/BRK%2FB_" in targets["BRK/B"]
    with pytest.raises(ValueError, match="already exists"):
        export.export_all_keys(store, spec, **run)


def test_an_export_that_failed_is_repeated(spark, store_of, monkeypatch):
    spec, folder = spec_for("grades"), new_folder(spark, "test-exports")
    store = store_of(*[(i, "grades", f"S{i}", "2024-01-01", '[{"date":"d"}]') for i in range(5)])
    run = dict(directory=folder, run="1", layout="file")
    with monkeypatch.context() as broken:
        broken.setattr(export, "FILES_DDL", "symbol INT, file INT")
        with pytest.raises(Exception):
            export.export_all_keys(store, spec, **run)
    path = export.export_all_keys(store, spec, **run)
    assert export.exported_files(spark, path).count() == 5
    assert len(glob.glob(f"{path.removeprefix('file:')}/*.csv")) == 5 and not glob.glob(f"{path}/_staged*")


def test_the_driver_does_nothing_per_named_file(spark, store_of, monkeypatch):
    client = spark.sparkContext._gateway._gateway_client
    send, calls = client.send_command, []
    monkeypatch.setattr(client, "send_command", lambda *a, **k: (calls.append(1), send(*a, **k))[1])

    def export_of(n: int) -> int:
        store = store_of(*[(i, "grades", f"S{i}", "2024-01-01", '[{"date":"d"}]') for i in range(n)])
        folder = new_folder(spark, "test-exports")
        calls.clear()
        path = export.export_all_keys(store, spec_for("grades"), folder, "1", layout="file", only_declared=True)
        made = len(calls)
        assert len(glob.glob(f"{path}/*.csv")) == n
        return made

    # Some calls free objects that were made before.
    assert export_of(200) - export_of(5) < 100


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_named_files_hold_what_spark_would_write(spark, store_of, fmt):
    store, spec, folder = _news(store_of), spec_for("news"), new_folder(spark, "test-exports")
    path = export.export_all_keys(store, spec, folder, "1", layout="file", fmt=fmt)
    flat = export.export_all_keys(store, spec, folder, "2", layout="flat", fmt=fmt)
    if fmt == "parquet":
        read, wanted = (spark.read.parquet(p).select("pos", "title", "site") for p in (path, flat))
        assert sorted(map(str, read.collect())) == sorted(map(str, wanted.collect()))
    else:
        wanted = "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{flat}/part-*")))
        (name,) = glob.glob(f"{path}/A_*.csv")
        text = open(name, newline="").read().split("\n", 1)
        assert text[0] == ",".join(["pos", *spec.keys]) and text[1].count("\n") == 1 + len(TEXTS)
        assert all(line.removeprefix("A,") in text[1] for line in wanted.split("\n") if line.startswith("A,"))


def test_an_export_by_symbol_is_there_as_a_whole_or_not_at_all(spark, store_of):
    folder, spec = new_folder(spark, "test-exports"), spec_for("news")
    records = export.export_records(_news(store_of), spec)
    broken = records.withColumn("site", F.when(F.col("symbol") == "C", F.raise_error(F.lit("no"))).otherwise(F.col("site")))
    path = f"{folder}/news/run=1"
    with pytest.raises(Exception, match="no"):
        export.write_export(broken, path, layout="symbol")
    assert not glob.glob(f"{folder}/news/*")
    # What failed can be repeated.
    export.write_export(records, path, layout="symbol")
    assert glob.glob(f"{path}/_SUCCESS") and not glob.glob(f"{folder}/news/_staged*")


ODD_TEXTS = [*TEXTS, "  blanks ", "cr\rhere", "cr\r\nlf", '"', '""\n"', ",", "\n", "﻿x", "#no comment", "null"]


@pytest.mark.parametrize("layout", ["file", "symbol"])
def test_files_read_by_the_tasks_hold_what_spark_reads(spark, layout, monkeypatch):
    # Files of null and empty symbols have names that Spark's readers take for hidden.
    symbols = ["A", "BRK/B", "a=b", "50%", "é {x}", *([None, ""] if layout == "symbol" else [])]
    data = [(s, i, t, i / 4 if i % 3 else None) for s in symbols for i, t in enumerate(ODD_TEXTS)]
    records = spark.createDataFrame(data, "symbol STRING, pos BIGINT, `odd, title` STRING, n DOUBLE")
    path = f"{new_folder(spark, 'test-exports')}/run=1"
    if layout == "file":
        export.write_named_files(records, path, spec_for("news"), "1")
    else:
        export.write_export(records, path, layout="symbol", max_records_per_file=4)
    schema = "pos BIGINT, title STRING, n DOUBLE"
    listed = spark.read.options(**export.CSV_OPTIONS)
    if layout == "symbol":
        wanted = listed.schema(f"{schema}, symbol STRING").csv(path).select("symbol", "pos", "title", "n")
    else:
        wanted = listed.schema(schema).csv(path).select("pos", "title", "n")
    wanted = sorted(map(str, wanted.collect()))
    for name, value in (("RECORDS", 3), ("BATCH_CHARS", 20)):
        monkeypatch.setattr(export, name, value)
    read = export.read_files(spark, path, schema)
    assert sorted(map(str, read.select(*["symbol"][: layout == "symbol"], "pos", "title", "n").collect())) == wanted
    assert len(wanted) == len(data)
    files = {r["file"] for r in read.select("file").distinct().collect()}
    on_disk = glob.glob(f"{path}/**/*.csv", recursive=True)
    assert files == {f.removeprefix(f"{path}/") for f in on_disk}
    if layout == "symbol":
        # Null and empty symbols share a folder.
        assert {r["symbol"] for r in read.select("symbol").distinct().collect()} == {*symbols} - {""}
        sizes = [r["n"] for r in read.groupBy("file").agg(F.count("*").alias("n")).collect()]
        assert max(sizes) == 4 and sum(sizes) == len(data)


def test_an_export_without_records_is_read(spark, store_of):
    folder, store = new_folder(spark, "test-exports"), _news(store_of).filter("symbol = 'none'")
    for layout in ("file", "symbol"):
        path = export.export_all_keys(store, spec_for("news"), folder, layout, layout=layout)
        assert export.read_files(spark, path, "pos BIGINT").collect() == []


@pytest.mark.parametrize("name", ["export_all_keys", "export_named_files"])
def test_the_driver_lists_no_exported_file(spark, name):
    """Only the table of files, however many there are."""
    from tests.conftest import SF_SMALL
    from workloads.queries import queries

    read = queries()[name](spark, SF_SMALL)
    assert read.inputFiles() and all("/_files/" in f for f in read.inputFiles())
    assert read.count() > 0


def test_declared_keys_are_not_decoded_again(store_of):
    """Their types are known; a kind is only looked up of others."""
    body = [{"date": "x", "currentRatio": 1, "other": 2}, {"date": "y", "other": 2.5}, {"date": None}]
    store = store_of((1, "ratios", "A", "2024-01-01", json.dumps(body)), (2, "ratios", "B", "2024-01-01", '[{"date":"z"}]'))
    latest = store.select("symbol", "raw_data")
    assert export._found_types(latest, spec_for("ratios"), "own") == {"other": "DOUBLE"}
    assert export._found_types(latest.filter("symbol = 'B'"), spec_for("ratios"), "own") == {}

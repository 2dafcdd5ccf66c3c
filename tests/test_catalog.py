"""The catalogue is complete and consistent."""

import pytest
from pyspark.sql import types as T

from snapfolio.catalog import CATALOG, ENVELOPE, RECORDS, DatasetSpec, Field, spec_for


def test_types_paths_and_suffixes_are_unique():
    assert len(CATALOG) == 23
    for attribute in ("data_type", "path", "export_suffix"):
        assert len({getattr(s, attribute) for s in CATALOG}) == 23


@pytest.mark.parametrize("spec", CATALOG, ids=lambda s: s.data_type)
def test_payload_types_parse(spark, spec):
    payload = T.DataType.fromDDL(spec.payload_ddl)
    if spec.shape in (RECORDS, ENVELOPE):
        assert [f.name for f in payload.elementType.fields] == spec.keys
    else:
        assert payload.fieldNames() == [spec.member]


def test_rows_per_view():
    assert {s.data_type for s in CATALOG if s.top_n is None} == {"profile", "outlook"}
    assert {s.top_n for s in CATALOG} == {10, None}
    assert {s.data_type for s in CATALOG if s.sort_key is None} == {"holders", "profile", "outlook"}


def test_indicators_are_lower_case():
    assert [s.data_type for s in CATALOG if s.key_case == "lower"] == ["economic"]
    assert spec_for("economic").key_name == "indicator"


def test_bad_specs_are_refused():
    fields = (Field("date", "STRING", "Date"),)
    with pytest.raises(ValueError, match="shape"):
        DatasetSpec("x", "/x", "/{key}", "odd", "x", fields, sort_key="date")
    with pytest.raises(ValueError, match="sort key"):
        DatasetSpec("x", "/x", "/{key}", RECORDS, "x", fields, sort_key="day")

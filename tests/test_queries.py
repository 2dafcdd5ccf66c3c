"""Every registered query gives what its SQL gives."""

import pytest

from __spark_entry__ import entry, oracle_sql
from tests.compare import connect, differences
from tests.conftest import SF_SMALL
from workloads.queries import queries


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_every_query_has_sql():
    assert set(queries()) <= set(oracle_sql())


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["data_type", "symbol", "last_updated", "data_points"]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    assert differences(queries()[name](spark, SF_SMALL), con, oracle_sql()[name]) is None

"""Every query of the core against its SQL on the smallest data."""

from pathlib import Path

import pytest

from evidex.plans import catalog
from tests.oracle import connection, differences

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    return connection(DATA)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, sql, name):
    assert differences(spark, sql, catalog.QUERIES[name], catalog.ORACLE[name], DATA) == ""


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DATA).collect() is not None

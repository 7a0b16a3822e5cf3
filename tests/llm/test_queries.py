"""The queries of the problems on the smallest data: SQL where there is any, else the columns that are asked for."""

from pathlib import Path

import pytest

from evidex.llm import queries
from tests.oracle import connection, differences

DATA = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": "case_id identity_key", "p2_found": "source_file_id page_number", "p3_found": "case_id group_id", "p4_found": "id_a id_b", "p5_found": "id", "p7_found": "source_file_id page_number line_no kind", "p8_found": "doc_id item_id", "p10_found": "doc_id"}
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() >= 0 and (name not in COLUMNS or df.columns == COLUMNS[name].split())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, connection(DATA), queries.QUERIES[name], queries.ORACLE[name], DATA) == ""

import pytest

import __spark_entry__ as entry
from fleetwear.catalog import ORACLES, QUERIES
import oracle

FOLDER = "/root/testdata/sf0.001"
SQL = ORACLES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, con, key):
    assert oracle.compare(QUERIES[key](spark, FOLDER), con, SQL[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, key):
    assert QUERIES[key](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

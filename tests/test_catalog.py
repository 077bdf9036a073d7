"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, database
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert result.startswith(("ok", "rows only")), result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["subject_id", "split", "tokens", "timestamps"]
    assert df.count() > 0

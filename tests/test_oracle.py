"""Every registered query against its DuckDB oracle at sf0.01 (the driver's check)."""
import pytest

import __spark_entry__ as E
from conftest import SF01
from oracle_compare import compare, duck

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    problems, _ = compare(spark, con, name, E.queries()[name], ORACLES[name], SF01)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF01)
    assert df.count() > 0

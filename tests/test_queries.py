"""Each registered query against its SQL."""

import pytest

from quarry import queries as core
from tests.oracle import connect, same_rows

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(name, spark, sf_dir, con):
    df = core.queries()[name](spark, sf_dir)
    if name in SQL:
        same_rows(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

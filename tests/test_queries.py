import pytest

from augsearch.plans import registry
from tests.oracle import assert_same, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, SQL[name], con)
    else:
        assert df.count() > 0

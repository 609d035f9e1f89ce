"""Every registered query against its SQL on the small test tables."""

import pytest

from compare import connect, difference
from netweir.plans import load

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert name in SQL
    problem, _ = difference(df, con, SQL[name])
    assert problem is None, problem

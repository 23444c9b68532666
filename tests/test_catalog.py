"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import compare, connect
from rasterloom.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
        return
    n, problem = compare(con, df, SQL[name])
    assert problem is None
    assert n > 0


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 3


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)

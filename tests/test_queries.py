"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from conftest import *  # noqa: F403

from faretide.registry import load
from tools.check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(load()))
def test_query(spark, con, name):
    q = load()[name]
    got = q.build(spark, SF_DIR).toPandas()
    if q.sql:
        assert compare(got, con.execute(q.sql).df()) == ""
    else:
        assert len(got)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 968

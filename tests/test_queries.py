"""Every registered query against its checking SQL on the smallest data folder."""

import pytest

import __spark_entry__ as entry
from stipendia.plans.workload import REGISTRY
from tests.compare import connect, difference

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    if name in ORACLE:
        assert difference(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "college_id" and df.count() == 25

"""Every catalogue query against its SQL on the smallest tables."""

import os

import pytest

from tests.oracle import compare, connect
from trajlake import plans

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
plans.load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLES:
        assert compare(df, duck, plans.ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)

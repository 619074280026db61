"""Every query of the engine against its SQL on the smallest tables."""

import os

import pytest

from lodestack.plans.every import ORACLES, QUERIES
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, con, name):
    oracle.same(spark, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0

"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from tableflow.plans.oracles import ORACLES
from tableflow.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("key", QUERIES)
def test_query_equals_sql(spark, con, key):
    assert compare(queries()[key](spark, SF_DIR), con, oracle_sql()[key]) == ""


def test_entry(spark):
    assert entry(spark).count() > 0

"""Every registered query beside its SQL, on the smallest data."""

import os

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sql, name):
    ok, note = compare(spark, sql, FOLDER, name)
    assert ok, note


def test_registry(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).limit(1).count() == 1

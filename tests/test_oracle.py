"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from workload import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, text = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert ok, text

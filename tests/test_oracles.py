"""Every registered query with an oracle against DuckDB at the smallest scale, where the tables are at hand."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not found")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    line = compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert line.startswith(("ok", "rows")), line


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "refused" in df.columns


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

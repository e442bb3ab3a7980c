"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from keepsift.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def own():
    """The queries of the library without its llm subpackage, which has tests of its own."""
    registry.load()
    return list(registry.QUERIES)


def test_every_query_has_a_check():
    assert set(own()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", own())
def test_query(spark, con, name):
    diff, _, _ = compare(spark, con, FOLDER, name)
    assert diff is None, diff


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "total", "tier"] and df.count() > 0

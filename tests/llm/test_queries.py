"""Registered queries next to their SQL."""

import pytest

import __spark_entry__ as entry
from deltatree.llm.queries import ORACLES, QUERIES
from tools.check import compare, connect


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    ok, message, rows = compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok and rows, message

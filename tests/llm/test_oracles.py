"""Registered queries against their SQL."""

import pytest

from gridweave.llm.queries import LLM_ORACLES, LLM_QUERIES
from tools.check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, name).startswith("same")


@pytest.mark.parametrize("name", sorted(set(LLM_QUERIES) - set(LLM_ORACLES)))
def test_rows(spark, name):
    df = LLM_QUERIES[name](spark, SF_DIR)
    assert df.count() > 0

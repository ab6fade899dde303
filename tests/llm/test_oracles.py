"""Every corpus query with an oracle gives the oracle's rows."""

import os

import pytest

from tallyward.llm import oracle_sql, queries
from tests.oracle import connect, difference

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    assert difference(queries()[name](spark, SF_DIR), connect(SF_DIR), oracle_sql()[name]) is None

"""Every query with an oracle gives the oracle's rows; the others give some."""

import os

import pytest

import __spark_entry__ as entry_points
from tests.oracle import connect, difference
from workload import all_oracles, all_queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    frame = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(frame, database, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 5 and all(r["breakdown_ok"] for r in rows)

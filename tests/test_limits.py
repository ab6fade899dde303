"""Limits of each tenant: read, held against runs, and kept by a plan."""

import time

import pytest
from pyspark.sql import functions as F

from tallyward import Dataset
from tallyward.errors import ResourceLimitError, TenantContextError
from tallyward.operators.limits import TenantLimits, limit_breaches, limits_of
from tallyward.plans.catalog import MetricDefinition
from tallyward.plans.steps import Step, run_plan
from tests.conftest import values


@pytest.fixture(scope="module")
def limits(spark):
    rows = [("a", 10, None), ("b", None, 2), ("twice", 7, None), ("twice", 9, 4), ("open", 0, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "tenant_id string, max_rows_per_query long, query_timeout_seconds int")


def test_limits_of_a_tenant(spark, limits):
    assert limits_of(limits, " a ") == TenantLimits(max_rows_per_query=10)
    assert limits_of(limits, "b") == TenantLimits(query_timeout_seconds=2)
    assert limits_of(limits, "twice") == TenantLimits(max_rows_per_query=7, query_timeout_seconds=4)
    assert limits_of(limits, "unknown") == limits_of(limits.select("tenant_id"), "a") == TenantLimits()
    with pytest.raises(TenantContextError):
        limits_of(limits, None)


def test_breaches(spark, limits):
    runs = spark.createDataFrame(
        [(1, "a", 11, 30.0), (2, "a", 10, 30.5), (3, "b", 100_001, 2.5), (4, "twice", 8, 5.0), (5, "open", 10**9, 1e9), (6, None, 100_001, 1.0),
         (7, "new", None, 31.0), (8, "a", None, None)], "id int, tenant_id string, rows long, seconds double",
    )
    got = sorted(values(limit_breaches(runs, limits), "id", "limit", "used", "allowed"))
    rows, seconds = "max_rows_per_query", "query_timeout_seconds"
    assert got == [
        (1, rows, 11.0, 10.0), (2, seconds, 30.5, 30.0), (3, rows, 100_001.0, 100_000.0), (3, seconds, 2.5, 2.0), (4, rows, 8.0, 7.0),
        (4, seconds, 5.0, 4.0), (6, rows, 100_001.0, 100_000.0), (7, seconds, 31.0, 30.0),
    ]
    assert limit_breaches(runs.limit(0), limits).count() == 0
    defaults = limit_breaches(runs, limits.limit(0).select("tenant_id"))
    assert sorted(values(defaults, "id", "limit")) == [(2, seconds), (3, rows), (5, rows), (5, seconds), (6, rows), (7, seconds)]
    with pytest.raises(ValueError):
        limit_breaches(runs.select("id", "tenant_id"), limits)


def test_plan_keeps_its_tenants_limits(spark, orders):
    known = {"by": MetricDefinition("by", "revenue", "sum", "region"), "n": MetricDefinition("n", "*", "count")}
    run = run_plan(Dataset.from_frame(orders, "orders"), [Step("by"), Step("n")], known, limits=TenantLimits(max_rows_per_query=2, max_plan_steps=1))
    done = run.deliver(lambda number, step, frame: frame.collect())
    assert [len(r) for r in done.results] == [2] and [s.target for s in run.left_out] == ["n"] and done.checks.first()["truncated"]
    whole = run_plan(Dataset.from_frame(orders, "orders"), [Step("by")], known, max_rows=50, limits=TenantLimits(max_rows_per_query=2))
    assert len(whole.deliver(lambda number, step, frame: frame.collect()).results[0]) == 4


def test_step_over_its_tenants_seconds_is_cancelled(spark):
    slow = spark.range(0, 8, 1, 8).select(F.expr("reflect('java.lang.Thread', 'sleep', CAST(20000 AS BIGINT))").alias("s"), F.lit(1.0).alias("x"))
    fast = spark.createDataFrame([(1.0,)], "x double")
    run = run_plan(Dataset.from_frame(fast, "fast"), [Step("n")], {"n": MetricDefinition("n", "*", "count")}, limits=TenantLimits(query_timeout_seconds=1))
    start = time.monotonic()
    with pytest.raises(ResourceLimitError):
        run.deliver(lambda number, step, frame: slow.collect())
    assert time.monotonic() - start < 15

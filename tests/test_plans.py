"""The shape of the physical plans: one scan where one is promised, pushed filters, no Python."""

import pytest

from tallyward.operators import metrics, profile, stats, topn, verify
from tallyward.plans.catalog import MetricDefinition, generate_metrics
from pyspark.sql import functions as F
from tests.conftest import scans
from workload import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SF_DIR}/lineitem.parquet")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_one_scan(lines):
    assert scans(stats.describe(lines, ["l_quantity", "l_tax", "l_discount"])) == 1
    assert scans(stats.missingness(lines)) == 1
    assert scans(stats.correlation_matrix(lines)) == 1
    assert scans(profile.profile_frame(lines, "exact")) == 1
    assert scans(verify.verify_breakdown(lines, "l_tax", "l_returnflag")) == 1
    generated = [m for m in generate_metrics(profile.build_profile(lines)).values() if m.agg != "nunique"]
    assert scans(metrics.run_catalog(lines, generated)) == 1


def test_groups_and_total_share_a_shuffle(lines):
    for frame in (verify.verified_breakdown(lines, "l_tax", "l_returnflag"), stats.value_counts(lines, "l_partkey")):
        frame.collect()
        final = plan(frame).split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final


def test_upsert_sorts_nothing_before_its_shuffle(lines):
    rows = lines.select("l_orderkey", "l_linenumber", "l_shipdate")
    text = plan(topn.upsert(rows, rows.where("l_orderkey < 9"), ["l_orderkey", "l_linenumber"]))
    assert text.count("Exchange hashpartitioning") == 1
    above, below = text.split("Exchange hashpartitioning")
    assert "Window" in above and "Sort" not in below and "WindowGroupLimit" not in below


def test_filter_and_columns_reach_the_scan(lines):
    metric = MetricDefinition("m", "l_quantity", "sum", "l_linenumber")
    text = plan(metrics.run_metric(lines, metric, {"l_returnflag": "A"}))
    assert "EqualTo(l_returnflag,A)" in text
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_returnflag:string>" in text


def test_top_k_is_not_a_sort(lines):
    for frame in (stats.value_counts(lines, "l_partkey"), stats.anomaly_detect(lines, "l_quantity")):
        assert "TakeOrderedAndProject" in plan(frame) and "rangepartitioning" not in plan(frame)


def test_first_rows_are_limited_before_the_shuffle(lines):
    text = plan(topn.first_per_key(lines, ["l_suppkey"], [F.desc("l_shipdate"), F.col("l_orderkey")], 5))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(all_queries()[name](spark, SF_DIR))
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text

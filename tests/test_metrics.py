import pytest
from pyspark.sql import functions as F

from tallyward import Dataset
from tallyward.operators import metrics, profile
from tallyward.operators.guards import allowed_filters
from tallyward.plans.catalog import MetricDefinition, generate_metrics
from tests.conftest import values


def run(df, column, agg, group=None, filters=None, base=None, **options):
    definition = MetricDefinition("m", column, agg, group, base_filters=base or {})
    return metrics.run_metric(df, definition, filters, **options)


def test_scalars(orders):
    assert values(run(orders, "revenue", "sum")) == [(1400.0,)]
    assert values(run(orders, "revenue", "max")) == [(400.0,)]
    assert values(run(orders, "revenue", "min")) == [(100.0,)]
    assert values(run(orders, "*", "count")) == [(6,)]
    assert values(run(orders, "customer_id", "nunique")) == [(4,)]
    assert run(orders, "revenue", "mean").first()[0] == pytest.approx(233.3333333)


def test_filters(orders):
    assert values(run(orders, "revenue", "sum", filters={"region": "North"})) == [(400.0,)]
    assert values(run(orders, "revenue", "max", filters={"region": "North"})) == [(300.0,)]
    assert values(run(orders, "revenue", "min", filters={"region": "South"})) == [(200.0,)]
    assert values(run(orders, "revenue", "sum", filters={"region": "South"}, base={"region": "North"})) == [(600.0,)]
    assert values(run(orders, "revenue", "sum", filters={"region": "nowhere"})) == [(0.0,)]


def test_filter_value_is_never_sql(orders):
    assert values(run(orders, "*", "count", filters={"region": "North' OR '1'='1"})) == [(0,)]


def test_grouped_is_sorted_by_value(orders):
    got = values(run(orders, "revenue", "sum", "region"))
    assert got == [("South", 600.0), ("North", 400.0), ("West", 250.0), ("East", 150.0)]


def test_grouped_nunique_is_scalar_unless_asked(orders):
    assert values(run(orders, "customer_id", "nunique", "region")) == [(4,)]
    grouped = dict(values(run(orders, "customer_id", "nunique", "region", grouped_nunique=True)))
    assert grouped == {"North": 2, "South": 2, "East": 1, "West": 1}


def test_unknown_aggregate_and_column(orders):
    with pytest.raises(ValueError):
        run(orders, "revenue", "median")
    with pytest.raises(ValueError, match="revenue"):
        run(orders, "price", "sum")


def test_allowlist_drops_other_filters():
    assert allowed_filters({"region": "x", "revenue": 1}, ["region"]) == {"region": "x"}


def test_nan_and_boolean(spark):
    df = spark.createDataFrame([(float("nan"), True, "a"), (2.0, False, "a"), (4.0, True, None)], "x double, b boolean, g string")
    assert values(run(df, "x", "sum")) == [(6.0,)]
    assert values(run(df, "x", "max")) == [(4.0,)]
    assert values(run(df, "b", "sum", "g")) == [("a", 1.0), (None, 1.0)]


def test_integer_sum_does_not_overflow(spark):
    df = spark.range(4).selectExpr("9000000000000000000 AS big", "'a' AS g")
    assert values(run(df, "big", "sum", "g")) == [("a", 3.6e19)]


def test_generated_names(orders):
    found = Dataset("data", orders)
    names = list(found.metrics)
    assert names[:4] == ["total_revenue", "avg_revenue", "max_revenue", "min_revenue"]
    assert "total_order_id" not in names and "unique_order_id" in names and "revenue_by_region" in names
    assert "order_id_by_region" in names and "count_by_category" in names
    assert "total revenue" in found.metrics["total_revenue"].synonyms
    assert "total sales" in found.metrics["total_revenue"].synonyms
    strict = generate_metrics(found.profile, strict_ids=True)
    assert "order_id_by_region" not in strict


@pytest.mark.parametrize("groups", [0, 1, 2, 3, 5])
def test_run_catalog_equals_single_runs(spark, groups):
    rows = [(i, float(i % 7) if i % 5 else None, *[f"v{(i * (g + 3)) % (g + 2)}" if (i + g) % 11 else None for g in range(5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id bigint, x double, g0 string, g1 string, g2 string, g3 string, g4 string")
    df = df.select("item_id", "x", *[f"g{i}" for i in range(groups)])
    generated = list(generate_metrics(profile.build_profile(df)).values())
    generated.append(MetricDefinition("filtered", "x", "sum", base_filters={"item_id": 3}))
    fused = {(r["metric"], r["key"]): r["value"] for r in metrics.run_catalog(df, generated, [f"g{i}" for i in range(0, groups, 2)]).collect()}
    single = {}
    for metric in generated:
        for row in metrics.run_metric(df, metric).collect():
            key = row["key"] if "key" in row else None
            single[(metric.name, key)] = None if row["value"] is None else float(row["value"])
    assert fused.keys() == single.keys()
    for key, value in single.items():
        assert fused[key] == (None if value is None else pytest.approx(value)), key


def test_run_catalog_with_seventy_groups(spark):
    df = spark.range(30).select("id", *[(F.col("id") % (i % 9 + 2)).cast("string").alias(f"g{i}") for i in range(70)])
    wanted = [MetricDefinition(f"m{i}", "id", "sum", f"g{i}") for i in range(70)] + [MetricDefinition("all", "id", "sum")]
    got = {(r["metric"], r["key"]): r["value"] for r in metrics.run_catalog(df, wanted).collect()}
    expected = {(f"m{i}", str(k)): float(sum(x for x in range(30) if x % (i % 9 + 2) == k)) for i in range(70) for k in range(i % 9 + 2)}
    assert got == expected | {("all", None): 435.0}


def test_run_catalog_on_empty_table(orders):
    empty = orders.where("1 = 0")
    generated = generate_metrics(profile.build_profile(orders))
    scalars = [m for m in generated.values() if not m.groupby]
    got = {r["metric"]: r["value"] for r in metrics.run_catalog(empty, scalars).collect()}
    assert got["total_revenue"] == 0.0 and got["row_count"] == 0.0 and got["unique_order_id"] == 0.0

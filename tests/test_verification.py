import pytest
from pyspark.sql import functions as F

from tallyward.frames import small_frame
from tallyward.operators import charts, insights, profile, stats, verify
from tallyward.plans.catalog import generate_metrics
from tests.conftest import scans, values

SCHEMA = "i int, target string, value double, source_rows bigint, breakdown_sum double, expected_total double, truncated boolean, plan_type string, error string, parse_failed boolean"


def checked(spark, **result):
    row = {"i": 1, "target": "m", "plan_type": "single_metric", **result}
    return verify.with_confidence(verify.result_flags(small_frame(spark, [row], SCHEMA))).first()


def test_flags_and_confidence(spark):
    clean = checked(spark, value=5.0)
    assert (clean["flags"], clean["confidence"], clean["passed"]) == ([], "high", True)
    assert checked(spark, value=5.0, plan_type="stats_tool")["confidence"] == "medium"
    over = checked(spark, target="Row_Count", value=10.0, source_rows=5)
    assert (over["flags"], over["confidence"], over["passed"]) == (["count_exceeds_row_count:row_count"], "low", False)
    assert checked(spark, target="total_sales", value=-1.0)["flags"] == ["unexpected_negative:total_sales"]
    assert checked(spark, target="margin", value=-1.0)["flags"] == []
    assert checked(spark, breakdown_sum=100.0, expected_total=100.005)["flags"] == []
    assert checked(spark, breakdown_sum=100.0, expected_total=101.0)["flags"] == ["breakdown_total_mismatch:m"]
    assert checked(spark, breakdown_sum=100.0, expected_total=0.0)["flags"] == []
    assert checked(spark, truncated=True)["flags"] == ["result_truncated:m"]
    for broken in ({"error": "x"}, {"parse_failed": True}):
        row = checked(spark, **broken)
        assert (row["confidence"], row["passed"]) == ("low", False)


def test_missing_columns_say_nothing(spark):
    row = verify.result_flags(spark.createDataFrame([("count", 9.0)], "target string, value double")).first()
    assert row["flags"] == []


def test_breakdown_equals_total(spark, orders):
    row = verify.verify_breakdown(orders, "revenue", "region").first()
    assert (row["breakdown_sum"], row["expected_total"], row["ok"]) == (1400.0, 1400.0, True)
    with_null = orders.withColumn("region", F.nullif("region", F.lit("North")))
    got = values(verify.verified_breakdown(with_null, "revenue", "region"))
    assert got == [("South", 600.0, True), (None, 400.0, True), ("West", 250.0, True), ("East", 150.0, True)]
    assert verify.verify_breakdown(orders.where("1 = 0"), "revenue", "region").first()["ok"]
    trend = verify.verified_trend(orders, "order_date", "revenue", "M")
    assert trend.count() == 6 and {r["breakdown_ok"] for r in trend.collect()} == {True}


def test_small_results(orders):
    assert verify.small_result(orders.limit(2)) and not verify.small_result(orders.limit(3))
    assert verify.downgrade_small("high", True) == ("low", [verify.SMALL_RESULT_CAVEAT])
    assert verify.downgrade_small("medium", True) == ("medium", []) and verify.downgrade_small("high", False) == ("high", [])


def test_lineage(orders):
    row = verify.with_lineage(orders.limit(1), ["total_revenue"], {"region": "North"}, "n").first()["lineage"]
    assert row.asDict() == {"metrics_or_tools_used": ["total_revenue"], "filters_applied": {"region": "North"}, "notes": "n"}
    assert verify.with_lineage(orders.limit(1), []).first()["lineage"]["filters_applied"] == {}


def found(df):
    known = profile.build_profile(df)
    return insights.insights(df, known, profile.profile_frame(df), generate_metrics(known)).collect()


def test_outlier_and_breakdown_insights(spark):
    df = spark.createDataFrame([(1.0, "N"), (2.0, "S")] * 10 + [(100.0, "N")], "revenue double, region string")
    rows = {r["type"]: r for r in found(df)}
    assert rows["outlier"]["detail"] == "1 statistical outlier(s) detected." and rows["outlier"]["severity"] == "notice"
    assert rows["breakdown"]["detail"] == "N leads at 110.00."


def test_all_outliers_are_counted(spark):
    df = spark.range(30_000).select((F.when(F.col("id") % 30 == 0, 100.0).otherwise(1.0)).alias("x"))
    assert insights.outlier_insight(df, "x").first()["detail"] == "1000 statistical outlier(s) detected."


def test_delivered_breakdown(spark, orders):
    by_region = stats.group_compare(orders, "revenue", "region")
    assert verify.delivered_check(by_region, orders, "revenue").first()["ok"]
    lost = verify.delivered_check(by_region.where("key != 'East'"), orders, "revenue").first()
    assert (lost["breakdown_sum"], lost["expected_total"], lost["ok"]) == (1250.0, 1400.0, False)
    assert not verify.delivered_check(by_region.limit(0), orders, "revenue").first()["ok"]


def test_missing_and_correlation_insights(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else "ok", i, -2 * i) for i in range(20)], "status string, x int, y int")
    rows = {r["type"]: r for r in found(df)}
    assert rows["missingness"]["detail"] == "25.0% of rows are missing status."
    assert rows["correlation"]["title"] == "x and y are correlated" and rows["correlation"]["detail"] == "Correlation of -1.00."


def test_insights_are_capped_with_notices_first(spark):
    df = spark.range(20).select(*[F.when(F.col("id") % 2 == 0, "a").alias(f"s{i}") for i in range(10)])
    rows = found(df)
    assert [r["title"] for r in rows] == [f"s{i} has missing values" for i in range(4)]


def test_report(orders):
    known = profile.build_profile(orders)
    rows = insights.baseline_report(orders, known).collect()
    sections = {r["section"] for r in rows}
    assert {"overview", "top segment", "correlation", "statistics", "distribution", "trend"} <= sections and "missing" not in sections
    assert next(r["value"] for r in rows if r["label"] == "revenue.mean") == "233.33"


def test_report_is_one_scan_beside_the_outliers(spark, folder):
    days = F.expr("date_add(date'2024-01-01', CAST(id % 90 AS INT))")
    spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("g"), days.alias("day"), (F.col("id") * -2.0).alias("x")).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    report = insights.baseline_report(df, profile.build_profile(df))
    outlier_pass = scans(stats.outlier_scores(df, "id").agg(F.count("*")))
    assert scans(report) == 1 + outlier_pass
    rows = {(r["section"], r["position"], r["label"]): r["value"] for r in report.collect()}
    assert rows["correlation", 0, "strong"] == "-1.00" and rows["statistics", 2, "g.n_unique"] == "7"
    assert rows["distribution", 1, "0"] == "143" and rows["distribution", 7, "6"] == "142" and ("distribution", 8, "7") not in rows
    assert [k[2] for k in sorted(rows) if k[0] == "trend"] == ["2024-01-01", "2024-02-01", "2024-03-01"]
    assert not any(k[0] in ("missing", "outliers") for k in rows)


def test_report_of_odd_tables(spark):
    """Text that is no date, NaN, nulls, a column named like a slot, and a table without rows or numbers."""
    rows = [(None, 1.5, "2024-01-05"), ("x", float("nan"), "no date"), ("x", None, None), ("y", 4.5, "2024-02-01")] * 10
    df = spark.createDataFrame(rows, "g string, v double, date string")
    known = profile.build_profile(df)
    report = lambda frame, found=known: {(r["section"], r["label"]): (r["position"], r["value"]) for r in insights.baseline_report(frame, found).collect()}
    got = report(df)
    assert got["missing", "v"] == (2, "20") and got["missing", "g"] == (1, "10") and got["statistics", "v.mean"] == (2, "3.00")
    assert got["top segment", "y"] == (0, "45.00") and got["distribution", "x"] == (1, "20") and got["distribution", None] == (3, "10")
    assert (got["trend", "2024-01-01"], got["trend", "2024-02-01"]) == ((0, "15.00"), (0, "45.00")) and got["overview", "rows"] == (0, "40")
    empty = report(df.limit(0))
    assert empty["overview", "rows"] == (0, "0") and empty["statistics", "v.nulls"] == (2, "0") and not any(k[0] in ("trend", "distribution") for k in empty)
    words = df.select("g", F.col("date").alias("note"))
    assert report(words, profile.build_profile(words))["overview", "columns"] == (1, "2")


@pytest.mark.parametrize("n", [3, 50, 60])
def test_charts(spark, n):
    bars = charts.bar_data(spark.range(n).select(F.col("id").alias("key"), F.col("id").cast("double").alias("value"))).collect()
    assert len(bars) == min(n, 50) and {r["truncated"] for r in bars} == {n > 50} and bars[0]["category"] == str(n - 1)
    line = charts.line_data(spark.range(n).select(F.expr("date_add(date'2024-01-01', CAST(id AS INT))").alias("period"), F.lit(1.0).alias("value")))
    assert line.first()["date"] == "2024-01-01" and line.count() == min(n, 50)


def test_breakdown_is_a_line_if_its_largest_groups_look_like_dates(spark):
    made = lambda *keys: spark.createDataFrame([(k, float(i)) for i, k in enumerate(keys)], "key string, value double")
    found = lambda frame, n=50: values(charts.breakdown_data(frame, n), "kind", "category", "truncated")
    days = [f"2024-{m:02d}" for m in (3, 1, 2, 6, 5, 4)]
    assert found(made("other", *days)) == [("line", k, False) for k in sorted([*days, "other"])]
    assert found(made(*days), 2) == [("line", "2024-01", True), ("line", "2024-02", True)]
    assert found(made(*days, "other")) == [("bar", k, False) for k in ["other", *reversed(days)]]
    assert found(made(*days, None))[0] == ("bar", None, False) and found(made()) == []
    assert found(spark.createDataFrame([(2024, 1.0)], "key int, value double")) == [("bar", "2024", False)]


def test_heatmap(orders):
    assert charts.heatmap_data(stats.correlation_matrix(orders)).columns == ["row", "col", "value"]


def test_plans_gather_kinds_only(spark):
    rows = [{"i": i, "target": "row_count", "value": 9.0, "source_rows": 5, "truncated": i == 1, "plan_type": "single_metric"} for i in range(3)]
    rows.append({"i": 9, "target": "x", "value": 1.0, "plan_type": "other"})
    plans = {r["plan_type"]: r for r in verify.verify_plan_results(small_frame(spark, rows, SCHEMA).withColumn("plan_id", F.lit(1))).collect()}
    bad = plans["single_metric"]
    assert (bad["n_flags"], bad["kinds"], bad["confidence"], bad["passed"]) == (4, ["count_exceeds_row_count", "result_truncated"], "low", False)
    assert (plans["other"]["n_flags"], plans["other"]["kinds"], plans["other"]["confidence"]) == (0, [], "medium")

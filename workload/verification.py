"""Result checks, insights and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators import charts, insights, metrics, profile, stats, verify
from tallyward.dataset import Dataset
from tallyward.plans.catalog import JoinPolicy, MetricDefinition, generate_metrics
from tallyward.plans.steps import Step, run_plan
from tallyward.sources.registry import DatasetRegistry
from workload.inputs import oracle, table, view
from workload.profiling import COLUMNS, roles_sql
from workload.statistics import HOLES, LINE_MATRIX, _holes, describe_sql, matrix_sql

# Step results per customer: what a plan might have returned, some of it wrong.
RESULTS = """
SELECT o_custkey AS plan_id, o_orderkey AS step_id,
       CASE o_orderstatus WHEN 'F' THEN 'row_count' WHEN 'O' THEN 'Total_Sales' ELSE 'margin' END AS target,
       CASE WHEN o_orderpriority = '5-LOW' THEN -o_totalprice ELSE o_totalprice END AS value,
       CASE WHEN o_orderstatus = 'F' THEN CAST(300000 AS BIGINT) END AS source_rows,
       CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS breakdown_sum,
       CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice * 1.01 ELSE o_totalprice + 0.005 END END AS expected_total,
       o_totalprice > 490000 AS truncated,
       CASE WHEN o_totalprice < 3000 THEN 'Timeout' END AS error,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'single_metric' ELSE 'multi_step' END AS plan_type
FROM {orders}
"""

FLAGGED = """
SELECT *, list_filter([
    CASE WHEN contains(lower(target), 'count') AND value > source_rows THEN 'count_exceeds_row_count:' || lower(target) END,
    CASE WHEN value < 0 AND regexp_matches(lower(target), 'revenue|sales|price|amount|quantity') THEN 'unexpected_negative:' || lower(target) END,
    CASE WHEN expected_total <> 0 AND abs(breakdown_sum - expected_total) > greatest(0.01, abs(expected_total) * 0.0001)
         THEN 'breakdown_total_mismatch:' || lower(target) END,
    CASE WHEN truncated THEN 'result_truncated:' || lower(target) END], lambda f: f IS NOT NULL) AS flags FROM results
"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RESULTS)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.result_flags(_results(spark, sf_dir)).select("step_id", F.concat_ws(",", "flags").alias("flags"))


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = verify.with_confidence(verify.result_flags(_results(spark, sf_dir)))
    return checked.select("step_id", "confidence", "passed")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = verify.verify_plan_results(_results(spark, sf_dir))
    return checked.withColumn("kinds", F.concat_ws(",", "kinds"))


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"breakdown_sum": F.round("breakdown_sum", 2), "expected_total": F.round("expected_total", 2)})


def _null_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(verify.verify_breakdown(_holes(spark, sf_dir), "value", "event_type"))


def _profiled(spark: SparkSession, sf_dir: str, name: str):
    rows = table(spark, sf_dir, name)
    return rows, profile.build_profile(rows, name, with_examples=True)


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _holes(spark, sf_dir)
    found = profile.build_profile(rows, "events")
    return insights.insights(rows, found, profile.profile_frame(rows, "exact"), generate_metrics(found))


def _leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = metrics.run_metric(table(spark, sf_dir, "orders"), MetricDefinition("m", "o_totalprice", "sum", "o_orderpriority"))
    return insights.leader(result).withColumn("value", F.round("value", 2))


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.missing_insight(profile.profile_frame(_holes(spark, sf_dir), "exact")).select("position", "severity", "title", "detail")


def _corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.correlation_insight(table(spark, sf_dir, "lineitem"), LINE_MATRIX, 0.0).select("title", "detail", "severity")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _profiled(spark, sf_dir, "orders")
    return insights.baseline_report(rows, found)


def _bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = metrics.run_metric(table(spark, sf_dir, "lineitem"), MetricDefinition("m", "*", "count", "l_suppkey"))
    return charts.bar_data(counted)


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = stats.trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "D")
    return charts.line_data(daily).withColumn("value", F.round("value", 2))


def _breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day, which is a line, and by priority, which is not."""
    orders = table(spark, sf_dir, "orders")
    made = [
        charts.breakdown_data(metrics.run_metric(orders, MetricDefinition("m", "o_totalprice", "max", group))).withColumn("by", F.lit(group))
        for group in ("o_orderdate", "o_orderpriority")
    ]
    return made[0].unionByName(made[1]).withColumn("value", F.round("value", 2))


PRIORITY_SUMS = MetricDefinition("price_by_priority", "o_totalprice", "sum", "o_orderpriority")
DAILY = Step("trend", "run_stats", args={"date_col": "o_orderdate", "value_col": "o_totalprice", "freq": "D"})


def _checks(run) -> DataFrame:
    return run.checks.select(
        "step", "target", F.round("breakdown_sum", 2).alias("breakdown_sum"), F.round("expected_total", 2).alias("expected_total"),
        "source_rows", "truncated", F.concat_ws(",", "flags").alias("flags"), "confidence", F.col("lineage.notes").alias("notes"),
    )


def _plan_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of a plan of four, the second cut by the row cap, so that its days no longer add up."""
    orders = Dataset.from_frame(table(spark, sf_dir, "orders"), "orders", mask=False)
    steps = [Step("price_by_priority", filters={"o_orderstatus": "F", "o_totalprice": 1}), DAILY, Step("price_by_priority"), DAILY]
    return _checks(run_plan(orders, steps, {"price_by_priority": PRIORITY_SUMS}, max_rows=50))


def _plan_run_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names through a join, masked as every loaded table is."""
    registry = DatasetRegistry()
    registry.register_table("orders", table(spark, sf_dir, "orders"))
    registry.register_table("customers", table(spark, sf_dir, "customer").withColumn("customer_name", F.col("c_name")))
    policies = {"oc": JoinPolicy("oc", "orders", "customers", "o_custkey", "c_custkey", status="approved")}
    orders = Dataset.from_frame(table(spark, sf_dir, "orders"), "orders", mask=False)
    run = run_plan(orders, [Step("value_counts", "run_stats", args={"column": "customer_name"}, join_policy="oc")], {}, registry, policies)
    return run.results[0][1]


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breakdown as delivered, and one that lost a group on the way."""
    lines = table(spark, sf_dir, "lineitem")
    whole = stats.group_compare(lines, "l_extendedprice", "l_returnflag")
    frames = {"whole": whole, "lost": whole.where("key != 'R'")}
    checks = [_rounded(verify.delivered_check(f, lines, "l_extendedprice")).withColumn("result", F.lit(n)) for n, f in frames.items()]
    return checks[0].unionByName(checks[1])


QUERIES = {
    "plan_run": _plan_run,
    "plan_run_joined": _plan_run_joined,
    "verify_delivered": _delivered,
    "verify_breakdown": lambda s, d: _rounded(verify.verify_breakdown(table(s, d, "lineitem"), "l_extendedprice", "l_returnflag")),
    "verify_breakdown_nulls": _null_breakdown,
    "verify_trend_total": lambda s, d: _rounded(verify.verify_trend_total(table(s, d, "orders"), "o_orderdate", "o_totalprice", "M")),
    "verify_flags": _flags,
    "verify_confidence": _confidence,
    "verify_plans": _plans,
    "insights": _insights,
    "insight_leader": _leader,
    "insight_missing": _missing,
    "insight_corr": _corr,
    "insight_outliers": lambda s, d: insights.outlier_insight(table(s, d, "events"), "value").select("title", "detail", "severity"),
    "baseline_report": _report,
    "chart_bar": _bar,
    "chart_line": _line,
    "chart_breakdown": _breakdowns,
    "chart_heatmap": lambda s, d: charts.heatmap_data(stats.correlation_matrix(table(s, d, "lineitem"))).withColumn("value", F.round("value", 6)),
}

# What stands out in the events with holes: the same checks, each as a query over them.
INSIGHTS = f"""
WITH h AS ({HOLES}), p AS ({roles_sql('events', f'({HOLES})')}),
s AS (SELECT avg(event_id) AS m, stddev_samp(event_id) AS sd FROM h),
o AS (SELECT count(*) AS n FROM h, s WHERE abs((event_id - m) / nullif(sd, 0)) >= 2.0),
b AS (SELECT event_type AS key, sum(event_id) AS value FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
c AS (SELECT * FROM (SELECT 'event_id' AS a, 'user_id' AS b, corr(event_id, user_id) AS r FROM h
      UNION ALL SELECT 'event_id', 'value', corr(event_id, value) FROM h UNION ALL SELECT 'user_id', 'value', corr(user_id, value) FROM h)
      ORDER BY abs(r) DESC LIMIT 1)
SELECT * FROM (
  SELECT 'notice' AS severity, CAST(1 AS INTEGER) AS check_no, CAST(0 AS INTEGER) AS position, 'outlier' AS type,
         'Outliers found in event_id' AS title, n || ' statistical outlier(s) detected.' AS detail FROM o WHERE n > 0
  UNION ALL SELECT 'info', 2, 0, 'trend', 'event_id trend over ts', 'See chart for movement over time.' FROM (SELECT 1 FROM h LIMIT 1)
  UNION ALL SELECT 'info', 3, 0, 'breakdown', 'Breakdown by event_type',
         coalesce(key, 'None') || ' leads at ' || format('{{:,.2f}}', CAST(value AS DOUBLE)) || '.' FROM b
  UNION ALL SELECT 'notice', 4, ordinal, 'missingness', name || ' has missing values',
         format('{{:.1f}}% of rows are missing {{}}.', n_null / n_rows * 100, name) FROM p WHERE n_null / n_rows > 0.05
  UNION ALL SELECT 'info', 5, 0, 'correlation', a || ' and ' || b || ' are correlated', format('Correlation of {{:.2f}}.', r) FROM c WHERE abs(r) > 0.5)
ORDER BY severity = 'info', check_no, position LIMIT 4
"""

# The report of the orders table, section by section.
REPORT = f"""
WITH d AS ({describe_sql('orders', ['o_orderkey', 'o_custkey', 'o_totalprice'], ['o_orderstatus', 'o_orderdate', 'o_orderpriority'])}),
r AS (SELECT corr(o_orderkey, o_custkey) AS r FROM orders),
s AS (SELECT avg(o_orderkey) AS m, stddev_samp(o_orderkey) AS sd FROM orders),
g AS (SELECT o_orderstatus AS key, sum(o_orderkey) AS value, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_orderkey) AS value FROM orders GROUP BY 1)
SELECT section, CAST(position AS INTEGER) AS position, label, value FROM (
  SELECT 'overview' AS section, 0 AS position, 'rows' AS label, CAST(count(*) AS VARCHAR) AS value FROM orders
  UNION ALL SELECT 'overview', 1, 'columns', '6'
  UNION ALL (SELECT 'top segment', 0, key, format('{{:,.2f}}', CAST(value AS DOUBLE)) FROM g ORDER BY value DESC, key LIMIT 1)
  UNION ALL SELECT 'correlation', 0, CASE WHEN abs(r) > 0.6 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END, format('{{:+.2f}}', r) FROM r
  UNION ALL SELECT 'outliers', 0, 'o_orderkey', CAST(count(*) AS VARCHAR) FROM orders, s WHERE abs((o_orderkey - m) / sd) >= 2.0 HAVING count(*) > 0
  UNION ALL SELECT 'statistics', list_position({list(COLUMNS['orders'])}, "column"), "column" || '.' || f, v FROM (
    SELECT "column", unnest(['count', 'nulls', 'n_unique', 'mean', 'std', 'min', 'max']) AS f,
           unnest([CAST(count AS VARCHAR), CAST(nulls AS VARCHAR), CAST(n_unique AS VARCHAR), format('{{:.2f}}', mean), format('{{:.2f}}', std),
                   format('{{:.2f}}', min), format('{{:.2f}}', max)]) AS v FROM d) WHERE v IS NOT NULL
  UNION ALL SELECT 'distribution', row_number() OVER (ORDER BY n DESC, key), key, CAST(n AS VARCHAR) FROM g
  UNION ALL SELECT 'trend', 0, CAST(period AS VARCHAR), format('{{:.2f}}', CAST(value AS DOUBLE)) FROM m)
"""

ORACLES = {
    "plan_run": """
        WITH d AS (SELECT sum(o_totalprice) AS value FROM orders GROUP BY CAST(o_orderdate AS DATE) ORDER BY CAST(o_orderdate AS DATE) LIMIT 50),
        t AS (SELECT sum(o_totalprice) AS whole, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS part, count(*) AS n,
                     count(DISTINCT CAST(o_orderdate AS DATE)) > 50 AS cut FROM orders)
        SELECT CAST(0 AS INTEGER) AS step, 'price_by_priority' AS target, round(part, 2) AS breakdown_sum, round(part, 2) AS expected_total, n AS source_rows,
               false AS truncated, '' AS flags, 'medium' AS confidence, 'filters not allowed: o_totalprice' AS notes FROM t
        UNION ALL SELECT 1, 'trend', round((SELECT sum(value) FROM d), 2), round(whole, 2), n, cut,
               CASE WHEN cut THEN 'breakdown_total_mismatch:trend,result_truncated:trend' ELSE '' END, CASE WHEN cut THEN 'low' ELSE 'medium' END, '' FROM t
        UNION ALL SELECT 2, 'price_by_priority', round(whole, 2), round(whole, 2), n, false, '', 'medium', '' FROM t""",
    "plan_run_joined": """SELECT 'Customer [REDACTED]' AS value, count(*) AS count, 100.0::DOUBLE AS pct, false AS truncated
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "verify_delivered": """WITH t AS (SELECT round(sum(l_extendedprice), 2) AS whole, round(sum(l_extendedprice) FILTER (l_returnflag <> 'R'), 2) AS part FROM lineitem)
        SELECT 'whole' AS result, whole AS breakdown_sum, whole AS expected_total, true AS ok FROM t UNION ALL SELECT 'lost', part, whole, false FROM t""",
    "insights": INSIGHTS,
    "baseline_report": REPORT,
    "verify_breakdown": "SELECT round(sum(l_extendedprice), 2) AS breakdown_sum, round(sum(l_extendedprice), 2) AS expected_total, true AS ok FROM lineitem",
    "verify_breakdown_nulls": f"SELECT round(sum(value), 2) AS breakdown_sum, round(sum(value), 2) AS expected_total, true AS ok FROM ({HOLES})",
    "verify_trend_total": "SELECT round(sum(o_totalprice), 2) AS breakdown_sum, round(sum(o_totalprice), 2) AS expected_total, true AS ok FROM orders",
    "verify_flags": oracle("SELECT step_id, array_to_string(flags, ',') AS flags FROM f", results=RESULTS, f=FLAGGED),
    "verify_confidence": oracle(
        """SELECT step_id, CASE WHEN error <> '' OR len(flags) > 0 THEN 'low' WHEN plan_type = 'single_metric' THEN 'high' ELSE 'medium' END
           AS confidence, NOT (coalesce(error, '') <> '' OR len(flags) > 0) AS passed FROM f""",
        results=RESULTS, f=FLAGGED,
    ),
    "verify_plans": oracle(
        """SELECT plan_id, plan_type, n_flags, concat_ws(',', CASE WHEN k1 THEN 'count_exceeds_row_count' END, CASE WHEN k2 THEN 'unexpected_negative' END,
           CASE WHEN k3 THEN 'breakdown_total_mismatch' END, CASE WHEN k4 THEN 'result_truncated' END) AS kinds, CASE WHEN bad OR n_flags > 0 THEN 'low' WHEN plan_type = 'single_metric' THEN 'high'
           ELSE 'medium' END AS confidence, NOT (bad OR n_flags > 0) AS passed FROM
           (SELECT plan_id, plan_type, CAST(sum(len(flags)) AS BIGINT) AS n_flags,
            bool_or(contains(array_to_string(flags, ','), 'count_exceeds')) AS k1, bool_or(contains(array_to_string(flags, ','), 'unexpected')) AS k2,
            bool_or(contains(array_to_string(flags, ','), 'mismatch')) AS k3, bool_or(contains(array_to_string(flags, ','), 'truncated')) AS k4, bool_or(coalesce(error, '') <> '') AS bad FROM f GROUP BY 1, 2)""",
        results=RESULTS, f=FLAGGED,
    ),
    "insight_leader": "SELECT o_orderpriority AS key, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "insight_missing": f"""SELECT ordinal AS position, 'notice' AS severity, name || ' has missing values' AS title,
        format('{{:.1f}}% of rows are missing {{}}.', n_null / n_rows * 100, name) AS detail
        FROM (SELECT * FROM ({roles_sql('events', f'({HOLES})')})) WHERE n_null / n_rows > 0.05""",
    "insight_outliers": """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
        SELECT 'Outliers found in value' AS title, count(*) || ' statistical outlier(s) detected.' AS detail, 'notice' AS severity
        FROM events, s WHERE abs((value - m) / sd) >= 2.0 HAVING count(*) > 0""",
    "insight_corr": f"""SELECT row || ' and ' || col || ' are correlated' AS title, format('Correlation of {{:.2f}}.', r) AS detail, 'info' AS severity
        FROM (SELECT row, col, r FROM ({matrix_sql('lineitem', LINE_MATRIX)}) WHERE row <> col
        ORDER BY abs(r) DESC, list_position({LINE_MATRIX}, row), list_position({LINE_MATRIX}, col) LIMIT 1)""",
    "chart_bar": """SELECT CAST(l_suppkey AS VARCHAR) AS category, count(*) AS value,
        (SELECT count(DISTINCT l_suppkey) FROM lineitem) > 50 AS truncated FROM lineitem GROUP BY l_suppkey ORDER BY 2 DESC, 1 LIMIT 50""",
    "chart_breakdown": """WITH d AS (SELECT o_orderdate AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)
        (SELECT 'line' AS kind, CAST(k AS VARCHAR) AS category, round(v, 2) AS value, (SELECT count(*) FROM d) > 50 AS truncated, 'o_orderdate' AS by
        FROM d ORDER BY k LIMIT 50) UNION ALL SELECT 'bar', o_orderpriority, round(max(o_totalprice), 2), false, 'o_orderpriority' FROM orders GROUP BY 2""",
    "chart_line": """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, round(sum(o_totalprice), 2) AS value,
        (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders) > 50 AS truncated FROM orders GROUP BY 1 ORDER BY 1 LIMIT 50""",
    "chart_heatmap": f"SELECT row, col, r AS value FROM ({matrix_sql('lineitem', LINE_MATRIX)})",
}

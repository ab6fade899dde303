"""The seven statistics tools and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.numbers import correlation_strength
from tallyward.operators import evaluation, percentiles, stats
from workload.inputs import table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_MATRIX = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS]


def _describe(name: str, columns: list[str] | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = stats.describe(table(spark, sf_dir, name), columns, "exact")
        return result.withColumns({c: F.round(c, 4) for c in ("mean", "std", "min", "max")})

    return query


def describe_sql(name: str, numbers: list[str], others: list[str]) -> str:
    """Describe rows, one query per column."""
    rows = [
        f"SELECT '{c}' AS \"column\", 'numeric' AS dtype, count({c}) AS count, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
        f"round(CAST(max({c}) AS DOUBLE), 4) AS max, count(*) - count({c}) AS nulls, CAST(NULL AS BIGINT) AS n_unique FROM {name}"
        for c in numbers
    ] + [
        f"SELECT '{c}' AS \"column\", 'categorical' AS dtype, count({c}) AS count, CAST(NULL AS DOUBLE) AS mean, "
        f"CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
        f"count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_unique FROM {name}"
        for c in others
    ]
    return " UNION ALL ".join(rows)


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls: error types, values under 10 and the first users are missing."""
    events = table(spark, sf_dir, "events")
    return events.withColumns(
        {
            "event_type": F.nullif("event_type", F.lit("error")),
            "value": F.when(F.col("value") >= 10, F.col("value")),
            "user_id": F.when(F.col("user_id") > 0, F.col("user_id")),
        }
    )


HOLES = """SELECT event_id, ts, CASE WHEN user_id > 0 THEN user_id END AS user_id, nullif(event_type, 'error') AS event_type,
           CASE WHEN value >= 10 THEN value END AS value, props FROM events"""


def _trend(freq: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats.trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", freq).withColumn("value", F.round("value", 2))

    return query


def _trend_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn(
        "day", F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return stats.trend(orders, "day", "o_totalprice", "M").withColumn("value", F.round("value", 2))


def trend_sql(unit: str) -> str:
    """Sum and count per period."""
    return f"""SELECT CAST(date_trunc('{unit}', CAST(o_orderdate AS DATE)) AS DATE) AS period,
               round(sum(o_totalprice), 2) AS value, count(*) AS n FROM orders GROUP BY 1"""


def _anomaly(name: str, column: str, threshold: float, limit: int, key: list[str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(*key, column)
        found = stats.anomaly_detect(rows, column, threshold, limit, tiebreak=key)
        return found.withColumns({"mean_val": F.round("mean_val", 4), "std_val": F.round("std_val", 4)})

    return query


def _outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outlier_scores(table(spark, sf_dir, "events"), "value", 1.5).select("event_id", "value", "z_score")


def anomaly_sql(name: str, column: str, threshold: float, limit: int, key: list[str]) -> str:
    """The most extreme rows."""
    keys = ", ".join(key)
    return f"""
    WITH s AS (SELECT avg({column}) AS m, stddev_samp({column}) AS sd FROM {name})
    SELECT {keys}, {column}, round(m, 4) AS mean_val, round(sd, 4) AS std_val, round(({column} - m) / nullif(sd, 0), 2) AS z_score
    FROM {name}, s WHERE abs(({column} - m) / nullif(sd, 0)) >= {threshold}
    ORDER BY abs(round(({column} - m) / nullif(sd, 0), 2)) DESC, {keys} LIMIT {limit}
    """


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation_matrix(table(spark, sf_dir, "lineitem")).withColumn("r", F.round("r", 6))


def matrix_sql(name: str, columns: list[str]) -> str:
    """The correlation matrix, one query per cell."""
    cells = [
        f"SELECT '{a}' AS row, '{b}' AS col, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + f" AS r FROM {name}"
        + (" LIMIT 1" if a == b else "")
        for a in columns for b in columns
    ]
    return " UNION ALL ".join(f"({c})" for c in cells)


def _correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation(_holes(spark, sf_dir), "value", "user_id").select(F.round("corr", 6).alias("corr"))


def _constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return stats.correlation(lines, "l_quantity", "one")


TEN = [*LINE_NUMBERS, *[f"half_{c}" for c in LINE_NUMBERS], "l_linenumber", "l_suppkey"]


def _ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten named columns, some with nulls."""
    lines = table(spark, sf_dir, "lineitem")
    halves = {f"half_{c}": F.when(F.col("l_partkey") % 2 == 0, F.col(c)) for c in LINE_NUMBERS}
    return stats.correlation_matrix(lines.withColumns(halves), TEN).withColumn("r", F.round("r", 6))


def _strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.strongest_pair(table(spark, sf_dir, "lineitem")).withColumn("r", F.round("r", 6))


def _strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = stats.correlation_matrix(table(spark, sf_dir, "lineitem"))
    return matrix.select("row", "col", correlation_strength(F.col("r")).alias("strength"))


def _compare(agg: str, digits: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = stats.group_compare(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linenumber", agg)
        return result.withColumn("value", F.round("value", digits))

    return query


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = percentiles.percentile_summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return summary.select(
        F.col("event_type").alias("phase"), "n", F.round("mean", 4).alias("mean"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")
    )


def _stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue per ship mode flag as repeated runs of a score."""
    lines = table(spark, sf_dir, "lineitem")
    runs = lines.groupBy("l_suppkey", "l_returnflag").agg(F.max("l_discount").alias("score"))
    result = evaluation.stability(runs, "score", ["l_suppkey"])
    return result.withColumn("spread", F.round("spread", 4))


QUERIES = {
    "describe_numeric": _describe("lineitem", LINE_NUMBERS),
    "describe_categorical": _describe("orders", ["o_orderstatus", "o_orderpriority", "o_orderdate"]),
    "describe_all": _describe("events", None),
    "value_counts": lambda s, d: stats.value_counts(table(s, d, "lineitem"), "l_partkey"),
    "value_counts_nulls": lambda s, d: stats.value_counts(_holes(s, d), "event_type", 0),
    "correlation": _correlation,
    "correlation_constant": _constant,
    "group_compare_sum": _compare("sum", 2),
    "group_compare_mean": _compare("mean", 4),
    "group_compare_max": _compare("max", 2),
    "group_compare_min": _compare("min", 2),
    "missingness": lambda s, d: stats.missingness(_holes(s, d)),
    "trend_month": _trend("M"),
    "trend_week": _trend("W"),
    "trend_day": _trend("D"),
    "trend_missing_dates": _trend_gaps,
    "anomaly_top20": _anomaly("events", "value", 2.0, 20, ["event_id"]),
    "anomaly_threshold": _anomaly("orders", "o_totalprice", 1.5, 20, ["o_orderkey"]),
    "outlier_rows": _outliers,
    "corr_matrix": _matrix,
    "corr_matrix_ten": _ten,
    "corr_strongest": _strongest,
    "corr_strength": _strength,
    "latency_summary": _latency,
    "stability": _stability,
}

ORACLES = {
    "describe_numeric": describe_sql("lineitem", LINE_NUMBERS, []),
    "describe_categorical": describe_sql("orders", [], ["o_orderstatus", "o_orderpriority", "o_orderdate"]),
    "describe_all": describe_sql("events", ["event_id", "user_id", "value"], ["ts", "event_type", "props"]),
    "value_counts": """SELECT l_partkey AS value, count(*) AS count,
        round_even(count(*)::DOUBLE / (SELECT count(*) FROM lineitem)::DOUBLE * 100.0 * 100.0, 0)::DOUBLE / 100.0 AS pct
        FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "value_counts_nulls": """SELECT nullif(event_type, 'error') AS value, count(*) AS count,
        round_even(count(*)::DOUBLE / (SELECT count(*) FROM events)::DOUBLE * 100.0 * 100.0, 0)::DOUBLE / 100.0 AS pct
        FROM events GROUP BY 1""",
    "correlation": f"SELECT round(corr(value, user_id), 6) AS corr FROM ({HOLES})",
    "correlation_constant": "SELECT 0.0::DOUBLE * count(*) AS corr FROM lineitem",
    "group_compare_sum": "SELECT l_linenumber AS key, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1",
    "group_compare_mean": "SELECT l_linenumber AS key, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1",
    "group_compare_max": "SELECT l_linenumber AS key, round(max(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1",
    "group_compare_min": "SELECT l_linenumber AS key, round(min(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1",
    "missingness": "SELECT *, round_even(nulls::DOUBLE / total::DOUBLE * 100.0 * 100.0, 0)::DOUBLE / 100.0 AS null_pct FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS nulls FROM ({HOLES})"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    )
    + ")",
    "trend_month": trend_sql("month"),
    "trend_week": trend_sql("week"),
    "trend_day": trend_sql("day"),
    "trend_missing_dates": """SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS period,
        round(sum(o_totalprice), 2) AS value, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
    "anomaly_top20": anomaly_sql("events", "value", 2.0, 20, ["event_id"]),
    "anomaly_threshold": anomaly_sql("orders", "o_totalprice", 1.5, 20, ["o_orderkey"]),
    "outlier_rows": """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
        SELECT event_id, value, round((value - m) / sd, 2) AS z_score FROM events, s WHERE abs((value - m) / sd) >= 1.5""",
    "corr_matrix": matrix_sql("lineitem", LINE_MATRIX),
    "corr_matrix_ten": matrix_sql(
        "(SELECT *, " + ", ".join(f"CASE WHEN l_partkey % 2 = 0 THEN {c} END AS half_{c}" for c in LINE_NUMBERS) + " FROM lineitem)", TEN
    ),
    "corr_strongest": f"""SELECT row, col, r FROM ({matrix_sql('lineitem', LINE_MATRIX)}) WHERE row <> col
        ORDER BY abs(r) DESC, list_position({LINE_MATRIX}, row), list_position({LINE_MATRIX}, col) LIMIT 1""",
    "corr_strength": f"""SELECT row, col, CASE WHEN abs(r) > 0.6 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END
        AS strength FROM ({matrix_sql('lineitem', LINE_MATRIX)})""",
    "latency_summary": """SELECT event_type AS phase, count(*) AS n, round(avg(value), 4) AS mean,
        round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""",
    "stability": """SELECT l_suppkey, min(score) AS lowest, max(score) AS highest, round(max(score) - min(score), 4) AS spread,
        max(score) - min(score) = 0 AS stable FROM
        (SELECT l_suppkey, l_returnflag, max(l_discount) AS score FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
}

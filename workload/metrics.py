"""Metric runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators import metrics, profile
from tallyward.plans.catalog import MetricDefinition, generate_metrics
from workload.inputs import table

FILTERS = {"l_returnflag": "A", "l_linestatus": "O"}
WHERE = "WHERE l_returnflag = 'A' AND l_linestatus = 'O'"


def _metric(column: str, agg: str, groupby: str | None = None, base: dict | None = None) -> MetricDefinition:
    return MetricDefinition("metric", column, agg, groupby, base_filters=base or {})


def _run(name: str, metric: MetricDefinition, digits: int | None = None, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = metrics.run_metric(table(spark, sf_dir, name), metric, **options)
        return result if digits is None else result.withColumn("value", F.round("value", digits))

    return query


def _null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return metrics.run_metric(events, _metric("value", "sum", "event_type")).withColumn("value", F.round("value", 2))


def _run_all(name: str, digits: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        found = profile.build_profile(rows, name)
        generated = generate_metrics(found)
        return metrics.run_catalog(rows, list(generated.values()), found.categorical).withColumn("value", F.round("value", digits))

    return query


MANY = [
    MetricDefinition(f"{agg}_{column}_by_{group}", column, agg, group)
    for group in ("l_suppkey", "l_partkey", "l_returnflag") for column, agg in (("l_quantity", "sum"), ("l_tax", "max"), ("*", "count"))
]


def _run_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog whose group columns a user approved although they have many values."""
    return metrics.run_catalog(table(spark, sf_dir, "lineitem"), MANY, ["l_returnflag"]).withColumn("value", F.round("value", 2))


def run_all_sql(name: str, numbers: list[str], groups: list[str], uniques: list[str], digits: int) -> str:
    """Every generated metric of a table, one after the other."""
    rounded = lambda e: f"round(CAST({e} AS DOUBLE), {digits})"
    parts = []
    for c in numbers:
        if not c.endswith("_id"):
            for prefix, agg in (("total", "sum"), ("avg", "avg"), ("max", "max"), ("min", "min")):
                parts.append(f"SELECT '{prefix}_{c}' AS metric, CAST(NULL AS VARCHAR) AS key, {rounded(f'{agg}({c})')} AS value FROM {name}")
    parts.append(f"SELECT 'row_count', NULL, {rounded('count(*)')} FROM {name}")
    for c in uniques:
        parts.append(f"SELECT 'unique_{c}', NULL, {rounded(f'count(DISTINCT {c})')} FROM {name}")
    for g in groups:
        for c in numbers:
            parts.append(f"SELECT '{c}_by_{g}', {g}, {rounded(f'sum({c})')} FROM {name} GROUP BY {g}")
            parts.append(f"SELECT 'avg_{c}_by_{g}', {g}, {rounded(f'avg({c})')} FROM {name} GROUP BY {g}")
        parts.append(f"SELECT 'count_by_{g}', {g}, {rounded('count(*)')} FROM {name} GROUP BY {g}")
    return " UNION ALL ".join(parts)


QUERIES = {
    "metric_sum": _run("lineitem", _metric("l_extendedprice", "sum"), 2),
    "metric_mean": _run("lineitem", _metric("l_extendedprice", "mean"), 4),
    "metric_row_count": _run("lineitem", _metric("*", "count")),
    "metric_nunique": _run("lineitem", _metric("l_partkey", "nunique")),
    "metric_max": _run("lineitem", _metric("l_extendedprice", "max")),
    "metric_min": _run("lineitem", _metric("l_extendedprice", "min")),
    "metric_sum_by": _run("lineitem", _metric("l_extendedprice", "sum", "l_returnflag"), 2),
    "metric_mean_by": _run("lineitem", _metric("l_discount", "mean", "l_linestatus"), 6),
    "metric_count_by": _run("orders", _metric("*", "count", "o_orderpriority")),
    "metric_max_by": _run("orders", _metric("o_totalprice", "max", "o_orderstatus")),
    "metric_min_by": _run("orders", _metric("o_totalprice", "min", "o_orderstatus")),
    "metric_nunique_by": _run("lineitem", _metric("l_suppkey", "nunique", "l_returnflag"), grouped_nunique=True),
    "metric_nunique_plain": _run("lineitem", _metric("l_suppkey", "nunique", "l_returnflag")),
    "metric_filtered_sum": _run("lineitem", _metric("l_quantity", "sum"), 2, filters=FILTERS),
    "metric_filtered_max": _run("lineitem", _metric("l_quantity", "max"), filters=FILTERS),
    "metric_filtered_by": _run("lineitem", _metric("l_quantity", "mean", "l_linenumber"), 6, filters=FILTERS),
    "metric_base_filters": _run(
        "lineitem", _metric("l_quantity", "sum", "l_linenumber", {"l_returnflag": "R", "l_linestatus": "F"}), 2,
        filters={"l_returnflag": "A"},
    ),
    "metric_empty": _run("lineitem", _metric("l_quantity", "sum"), 2, filters={"l_returnflag": "none"}),
    "metric_null_group": _null_group,
    "catalog_run_all": _run_all("events", 4),
    "catalog_run_all_wide": _run_all("lineitem", 2),
    "catalog_run_many_values": _run_many,
}

ORACLES = {
    "metric_sum": "SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem",
    "metric_mean": "SELECT round(avg(l_extendedprice), 4) AS value FROM lineitem",
    "metric_row_count": "SELECT count(*) AS value FROM lineitem",
    "metric_nunique": "SELECT count(DISTINCT l_partkey) AS value FROM lineitem",
    "metric_max": "SELECT max(l_extendedprice) AS value FROM lineitem",
    "metric_min": "SELECT min(l_extendedprice) AS value FROM lineitem",
    "metric_sum_by": "SELECT l_returnflag AS key, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1",
    "metric_mean_by": "SELECT l_linestatus AS key, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1",
    "metric_count_by": "SELECT o_orderpriority AS key, count(*) AS value FROM orders GROUP BY 1",
    "metric_max_by": "SELECT o_orderstatus AS key, max(o_totalprice) AS value FROM orders GROUP BY 1",
    "metric_min_by": "SELECT o_orderstatus AS key, min(o_totalprice) AS value FROM orders GROUP BY 1",
    "metric_nunique_by": "SELECT l_returnflag AS key, count(DISTINCT l_suppkey) AS value FROM lineitem GROUP BY 1",
    "metric_nunique_plain": "SELECT count(DISTINCT l_suppkey) AS value FROM lineitem",
    "metric_filtered_sum": f"SELECT round(sum(l_quantity), 2) AS value FROM lineitem {WHERE}",
    "metric_filtered_max": f"SELECT max(l_quantity) AS value FROM lineitem {WHERE}",
    "metric_filtered_by": f"SELECT l_linenumber AS key, round(avg(l_quantity), 6) AS value FROM lineitem {WHERE} GROUP BY 1",
    "metric_base_filters": """SELECT l_linenumber AS key, round(sum(l_quantity), 2) AS value FROM lineitem
                              WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1""",
    "metric_empty": "SELECT coalesce(round(sum(l_quantity), 2), 0.0) AS value FROM lineitem WHERE l_returnflag = 'none'",
    "metric_null_group": "SELECT nullif(event_type, 'error') AS key, round(sum(value), 2) AS value FROM events GROUP BY 1",
    "catalog_run_many_values": " UNION ALL ".join(
        f"SELECT '{m.name}' AS metric, CAST({m.groupby} AS VARCHAR) AS key, round(CAST({m.agg}({m.column}) AS DOUBLE), 2) AS value FROM lineitem GROUP BY {m.groupby}"
        for m in MANY
    ),
    "catalog_run_all": run_all_sql("events", ["event_id", "user_id", "value"], ["event_type"], ["event_id", "user_id"], 4),
    "catalog_run_all_wide": run_all_sql(
        "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus"], [], 2,
    ),
}

"""Running approved metrics: six aggregates, optional group, equality filters."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.frames import small_frame
from tallyward.operators.guards import (
    additive_sql,
    column_ref,
    identifier,
    inline_rows,
    is_numeric_type,
    require_columns,
    value_sql,
)
from tallyward.operators.profile import column_counts
from tallyward.plans.catalog import AGGREGATES, MetricDefinition

# Group columns known to have few values that are aggregated together in a whole-catalog run: at most 50 x 50 combinations.
BUNDLE = 2
# Group columns of one aggregation; an id of its grouping sets has a bit for each and 64 bits in all.
MOST_GROUPS = 60


def merge_filters(base: Mapping[str, object] | None, extra: Mapping[str, object] | None) -> dict[str, object]:
    """Base filters with the user's on top."""
    return {**(base or {}), **(extra or {})}


def equality_filter(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """Rows where every named column equals its value. Values are literals of the column's type, never SQL text."""
    if not filters:
        return df
    require_columns(df, list(filters))
    tests = [column_ref(k) == F.lit(v).cast(df.schema[k].dataType) for k, v in filters.items()]
    return df.where(reduce(lambda a, b: a & b, tests))


def aggregate(df: DataFrame, column: str, agg: str) -> Column:
    """The aggregate expression of a metric; null where there is nothing to aggregate."""
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregation {agg!r}")
    if agg == "count":
        return F.count("*")
    require_columns(df, [column])
    value = value_sql(df, column)
    if agg == "sum" and is_numeric_type(df.schema[column].dataType):
        value = additive_sql(df, column)
    sql = {
        "sum": "CAST(sum({}) AS DOUBLE)", "mean": "CAST(avg({}) AS DOUBLE)", "max": "max({})", "min": "min({})",
        "nunique": "count(DISTINCT {})",
    }
    return F.expr(sql[agg].format(value))


def run_metric(
    df: DataFrame,
    metric: MetricDefinition,
    filters: Mapping[str, object] | None = None,
    grouped_nunique: bool = False,
    approx_rsd: float | None = None,
) -> DataFrame:
    """One metric: a one-row frame (value), or (key, value) by descending value when the metric has a group.

    Grouped rows with equal values are in key order; the null group stays. A scalar over no rows is 0. A grouped
    distinct count is scalar, as documented, unless `grouped_nunique`; `approx_rsd` replaces the exact distinct
    count by a sketch.
    """
    rows = equality_filter(df, merge_filters(metric.base_filters, filters))
    value = aggregate(rows, metric.column, metric.agg)
    if metric.agg == "nunique" and approx_rsd is not None:
        value = F.approx_count_distinct(F.expr(value_sql(rows, metric.column)), approx_rsd)
    if metric.groupby and (metric.agg != "nunique" or grouped_nunique):
        require_columns(rows, [metric.groupby])
        result = rows.groupBy(column_ref(metric.groupby).alias("key")).agg(value.alias("value"))
        return result.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("key"))
    if metric.agg in ("sum", "mean", "max", "min"):
        value = F.coalesce(value.cast("double"), F.lit(0.0))
    return rows.agg(value.alias("value"))


def run_catalog(df: DataFrame, metrics: Sequence[MetricDefinition], few: Collection[str] = ()) -> DataFrame:
    """Every given metric at once as (metric, key, value); key is null for scalars and for the null group.

    All sums, means, extremes and counts, scalar or grouped, come from one scan for every 60 group columns. `few`
    names group columns known to have few values, as a profile's categorical ones: two of them are first
    aggregated together, and the small result is then split into the breakdowns of each and the total. Any other
    group column is aggregated by itself, as two of many values would make their product. Distinct counts take a
    second scan that counts all their columns together. Metrics with base filters are run one by one. All values
    share one column of doubles, which holds whole numbers up to 2 ** 53 exactly; run a metric by itself beyond.
    """
    metrics = list(metrics)
    filtered = [m for m in metrics if m.base_filters]
    plain = [m for m in metrics if not m.base_filters]
    uniques = [m for m in plain if m.agg == "nunique"]
    fused = [m for m in plain if m.agg != "nunique"]
    parts = []
    groups = list(dict.fromkeys(m.groupby for m in fused if m.groupby))
    for at in range(0, max(1, len(groups)), MOST_GROUPS):
        chosen = groups[at : at + MOST_GROUPS]
        batch = [m for m in fused if m.groupby in chosen or not m.groupby and at == 0]
        if batch:
            parts.append(_fused(df, batch, few))
    if uniques:
        columns = list(dict.fromkeys(m.column for m in uniques))
        counts = column_counts(df, columns, "exact").select(F.col("name").alias("_column"), "n_unique")
        names = small_frame(
            df.sparkSession, [{"metric": m.name, "_column": m.column} for m in uniques], "metric string, _column string"
        )
        parts.append(
            counts.join(names, "_column").select(
                "metric", F.lit(None).cast("string").alias("key"), F.col("n_unique").cast("double").alias("value")
            )
        )
    for metric in filtered:
        result = run_metric(df, metric)
        key = F.col("key").cast("string") if "key" in result.columns else F.lit(None).cast("string")
        parts.append(result.select(F.lit(metric.name).alias("metric"), key.alias("key"), F.col("value").cast("double")))
    return reduce(DataFrame.unionByName, parts)


def _fused(df: DataFrame, metrics: Sequence[MetricDefinition], few: Collection[str]) -> DataFrame:
    groups = list(dict.fromkeys(m.groupby for m in metrics if m.groupby))
    require_columns(df, groups)
    columns = list(dict.fromkeys(m.column for m in metrics if m.agg != "count"))
    require_columns(df, columns)
    # Group columns get names of their own: one may also be a measured column.
    source = df.selectExpr(
        *[f"CAST({identifier(g)} AS STRING) AS g{i}" for i, g in enumerate(groups)],
        *[f"CAST({value_sql(df, c)} AS DOUBLE) AS x{i}" for i, c in enumerate(columns)],
    )
    measures = [(f"s{i}", "sum", f"x{i}") for i in range(len(columns))] + [(f"c{i}", "count", f"x{i}") for i in range(len(columns))]
    measures += [(f"l{i}", "min", f"x{i}") for i in range(len(columns))] + [(f"h{i}", "max", f"x{i}") for i in range(len(columns))]
    parts = [F.expr("count(*) AS n"), *[F.expr(f"{f}({x}) AS {name}") for name, f, x in measures]]
    bundles = _bundles(groups, few)
    keys = [f"g{i}" for i in range(len(groups))]
    if len(bundles) > 1:
        sets = [[f"g{i}" for i in bundle] for bundle in bundles]
        partial = source.groupingSets(sets, *keys).agg(F.grouping_id().alias("set"), *parts)
    else:
        partial = source.groupBy(*keys).agg(*parts).withColumn("set", F.lit(0))
    # Each partial row goes to the group columns of its bundle; those of the first bundle also to the total.
    routes = []
    for position, bundle in enumerate(bundles):
        targets = [f"named_struct('group', {i}, 'key', g{i})" for i in bundle]
        if position == 0:
            targets.append("named_struct('group', -1, 'key', CAST(NULL AS STRING))")
        # grouping_id has a bit set for every column left out, the first column's highest.
        left_out = sum(1 << (len(groups) - 1 - i) for i in range(len(groups)) if i not in bundle) if len(bundles) > 1 else 0
        routes.append(f"WHEN set = {left_out} THEN array({', '.join(targets)})")
    merge = [F.expr(f"{'sum' if f == 'count' else f}({name}) AS {name}") for name, f, _ in measures]
    routed = partial.selectExpr("n", *[name for name, _, _ in measures], f"inline(CASE {' '.join(routes)} END)")
    totals = routed.groupBy("group", "key").agg(F.expr("sum(n) AS n"), *merge)
    wanted = list(dict.fromkeys((m.column if m.agg != "count" else "*", m.agg) for m in metrics))
    slots = inline_rows([{"slot": str(i), "value": _slot_sql(columns, *w)} for i, w in enumerate(wanted)])
    values = totals.select("group", "key", slots)
    rows = [
        {
            "metric": m.name, "group": groups.index(m.groupby) if m.groupby else -1,
            "slot": wanted.index((m.column if m.agg != "count" else "*", m.agg)),
        }
        for m in metrics
    ]
    named = small_frame(df.sparkSession, rows, "metric string, group int, slot int")
    value = F.when(F.col("group") == -1, F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    return values.join(named, ["group", "slot"]).select("metric", "key", value.alias("value"))


def _slot_sql(columns: Sequence[str], column: str, agg: str) -> str:
    """One aggregate of one column from the merged sums, counts and extremes."""
    if agg == "count":
        return "CAST(n AS DOUBLE)"
    i = columns.index(column)
    return {"sum": f"s{i}", "mean": f"CASE WHEN c{i} > 0 THEN s{i} / c{i} END", "max": f"h{i}", "min": f"l{i}"}[agg]


def _bundles(groups: Sequence[str], few: Collection[str]) -> list[list[int]]:
    """Group columns aggregated together, as places; without any, one empty bundle that holds the total."""
    small = [i for i, g in enumerate(groups) if g in few]
    pairs = [small[at : at + BUNDLE] for at in range(0, len(small), BUNDLE)]
    return pairs + [[i] for i, g in enumerate(groups) if g not in few] or [[]]

"""Governed two-table joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators.guards import column_ref, require_columns, value_sql
from tallyward.operators.metrics import aggregate, equality_filter, merge_filters, run_metric
from tallyward.plans.catalog import JoinPolicy, MetricDefinition

# Fixed value: suffix of a right column whose name is taken.
RIGHT_SUFFIX = "_joined"


def join_view(left: DataFrame, right: DataFrame, policy: JoinPolicy, null_safe: bool = True) -> DataFrame:
    """The joined view of two tables.

    The left table keeps its names; a right column whose name is taken gets the suffix, and keys of the same
    name become one column. Null keys match each other unless `null_safe` is off. The join is an equi-join with
    no hint: Spark broadcasts a side it knows to be small, and otherwise splits skewed keys at run time. Only
    the columns used later are read.
    """
    require_columns(left, [policy.left_key])
    require_columns(right, [policy.right_key])
    same_name = policy.left_key == policy.right_key
    taken = set(left.columns)
    renamed = {c: (c + RIGHT_SUFFIX if c in taken else c) for c in right.columns}
    renamed[policy.right_key] = "_right_key" if same_name else renamed[policy.right_key]
    other = right.select(*[column_ref(old).alias(new) for old, new in renamed.items()])
    left_key, right_key = column_ref(policy.left_key), column_ref(renamed[policy.right_key])
    matches = left_key.eqNullSafe(right_key) if null_safe else left_key == right_key
    joined = left.join(other, matches, policy.join_type)
    return joined.drop("_right_key") if same_name else joined


def joined_metric(
    left: DataFrame, right: DataFrame, policy: JoinPolicy, metric: MetricDefinition, filters: Mapping[str, object] | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """What `run_metric` gives on the joined view, without joining the rows.

    Each side is first summed up by its key, and by the group where that is its column; a pair of such rows stands for as many joined
    rows as the product of their numbers. A key that many rows of both sides have, null among them, so costs one row a group instead
    of the product. Filters are applied below the join. A distinct count can not be put together from parts: it runs on the view.

    Where the right table is small and has each key once there is no product, and the view is cheaper: it needs no sums by key.
    """
    if metric.agg == "nunique":
        return run_metric(join_view(left, right, policy, null_safe), metric, filters)
    require_columns(left, [policy.left_key])
    require_columns(right, [policy.right_key])
    names = {c: c for c in left.columns}
    same_name = policy.left_key == policy.right_key
    of_right = {(c + RIGHT_SUFFIX if c in names else c): c for c in right.columns if not (same_name and c == policy.right_key)}
    wanted = merge_filters(metric.base_filters, filters)
    used = [*wanted, *([metric.column] if metric.agg != "count" else []), *([metric.groupby] if metric.groupby else [])]
    if unknown := [c for c in used if c not in names and c not in of_right]:
        raise ValueError(f"no column {unknown[0]!r} in the joined view; there are {[*names, *of_right]}")
    right_filters = {of_right[c]: v for c, v in wanted.items() if c not in names}
    sides = []
    for df, key, known, own_filters in (
        (left, policy.left_key, names, {c: v for c, v in wanted.items() if c in names}), (right, policy.right_key, of_right, right_filters),
    ):
        mine = lambda c: c is not None and c in known and (known is names or c not in names)
        rows = equality_filter(df, own_filters)
        keys = [column_ref(key).alias("join_key")]
        if mine(metric.groupby):
            keys.append(column_ref(known[metric.groupby]).alias("key"))
        parts = [F.count("*").alias("n")]
        if metric.agg != "count" and mine(metric.column):
            column = known[metric.column]
            parts.append(aggregate(rows, column, "sum" if metric.agg == "mean" else metric.agg).alias("part"))
            parts.append(F.count(F.expr(value_sql(rows, column))).alias("present"))
        sides.append(rows.groupBy(*keys).agg(*parts))
    one, other = sides[0].withColumnRenamed("n", "n_left"), sides[1].withColumnsRenamed({"n": "n_right", "join_key": "right_key"})
    match = F.col("join_key").eqNullSafe(F.col("right_key")) if null_safe else F.col("join_key") == F.col("right_key")
    # A filter on the right column of a left join leaves no row without a partner.
    pairs = one.join(other, match, "inner" if right_filters else policy.join_type)
    times = lambda side: F.coalesce(F.col(side), F.lit(1))
    if metric.agg == "count":
        value = F.coalesce(F.sum(times("n_left") * times("n_right")), F.lit(0))
    else:
        others = times("n_right" if "part" in one.columns else "n_left").cast("double")
        total = F.sum(F.col("part").cast("double") * others) if metric.agg in ("sum", "mean") else None
        value = {
            "sum": total, "mean": None if total is None else F.try_divide(total, F.sum(F.col("present") * others)),
            "max": F.max("part"), "min": F.min("part"),
        }[metric.agg]
    if metric.groupby:
        return pairs.groupBy("key").agg(value.alias("value")).orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("key"))
    return pairs.agg((value if metric.agg == "count" else F.coalesce(value.cast("double"), F.lit(0.0))).alias("value"))


def policy_rows(policies: DataFrame) -> dict[str, JoinPolicy]:
    """Approved policies by name; driver work on a table of policies."""
    fields = ["name", "left_table", "right_table", "left_key", "right_key", "join_type", "description", "status"]
    rows = policies.where(F.col("status") == "approved").select(*fields).collect()
    return {r["name"]: JoinPolicy(**r.asDict()) for r in rows}

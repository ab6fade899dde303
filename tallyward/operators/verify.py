"""Checks on results; confidence is computed, never taken on trust."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.operators.guards import additive, column_ref, inline_rows, require_numeric
from tallyward.operators.metrics import equality_filter
from tallyward.operators.stats import period_of

# ---- Fixed values ---------------------------------------------------------------------------------------
RELATIVE_TOLERANCE = 1e-4
ABSOLUTE_TOLERANCE = 0.01
MONEY_TARGETS = ("revenue", "sales", "price", "amount", "quantity")
FLAG_KINDS = ("count_exceeds_row_count", "unexpected_negative", "breakdown_total_mismatch", "result_truncated")
SMALL_RESULT = 3
SMALL_RESULT_CAVEAT = "Small result set — interpret with caution."
# ---------------------------------------------------------------------------------------------------------


def close_to(total: Column, expected: Column) -> Column:
    """Equal within the absolute or the relative tolerance."""
    return F.abs(total - expected) <= F.greatest(F.lit(ABSOLUTE_TOLERANCE), F.abs(expected) * RELATIVE_TOLERANCE)


def verified_breakdown(
    df: DataFrame, value_col: str, group_col: str, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """(key, value, breakdown_ok): a grouped sum with the check that its groups add up to the total.

    Groups and grand total come from one scan; a null group is told from the total by a flag.
    """
    require_numeric(df, [value_col])
    rows = equality_filter(df, filters)
    return _checked(rows, column_ref(group_col), additive(df, value_col)).orderBy(
        F.desc_nulls_last("value"), F.asc_nulls_last("key")
    )


def verified_trend(df: DataFrame, date_col: str, value_col: str, freq: str = "M") -> DataFrame:
    """(key, value, breakdown_ok): a trend with the check that its periods add up to the dated total."""
    require_numeric(df, [value_col])
    dated = df.where(column_ref(date_col).isNotNull())
    return _checked(dated, period_of(df, date_col, freq), additive(df, value_col)).orderBy("key")


def _sums(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, is_total): the groups and the grand total, from one scan.

    A rollup spelled out. Being an aggregate, `is_total` can not be pushed below the shuffle as a rollup's grouping
    id is, so that readers of the groups and of the total share one shuffle instead of scanning once each.
    """
    pairs = rows.select(key.alias("k"), value.alias("x"))
    nothing = f"CAST(NULL AS {pairs.schema['k'].dataType.simpleString()})"
    both = pairs.select(
        inline_rows([{"key": "k", "total": "false", "x": "x"}, {"key": nothing, "total": "true", "x": "x"}])
    )
    return both.groupBy("key", "total").agg(F.sum("x").alias("value"), F.max("total").alias("is_total")).drop("total")


def _checked(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    sums = _sums(rows, key, value)
    return sums.where(~F.col("is_total")).select("key", "value", breakdown_check(sums).select("ok").scalar().alias("breakdown_ok"))


def breakdown_check(sums: DataFrame) -> DataFrame:
    """(breakdown_sum, expected_total, ok) from (key, value, is_total); a missing or zero total passes unchecked."""
    both = sums.agg(
        F.sum(F.when(~F.col("is_total"), F.col("value"))).alias("breakdown_sum"),
        F.coalesce(F.max(F.when(F.col("is_total"), F.col("value"))), F.lit(0)).alias("expected_total"),
    )
    close = close_to(F.col("breakdown_sum").cast("double"), F.col("expected_total").cast("double"))
    skip = F.col("expected_total").isNull() | (F.col("expected_total") == 0)
    return both.withColumn("ok", skip | F.coalesce(close, F.lit(True)))


def verify_breakdown(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """One row (breakdown_sum, expected_total, ok) for a grouped sum."""
    require_numeric(df, [value_col])
    return breakdown_check(_sums(df, column_ref(group_col), additive(df, value_col)))


def verify_trend_total(df: DataFrame, date_col: str, value_col: str, freq: str = "M") -> DataFrame:
    """One row (breakdown_sum, expected_total, ok) for a trend."""
    require_numeric(df, [value_col])
    dated = df.where(column_ref(date_col).isNotNull())
    return breakdown_check(_sums(dated, period_of(df, date_col, freq), additive(df, value_col)))


def source_total(rows: DataFrame, value_col: str) -> DataFrame:
    """One row (expected_total): the sum over a table, by itself."""
    require_numeric(rows, [value_col])
    return rows.agg(F.coalesce(F.sum(additive(rows, value_col)).cast("double"), F.lit(0.0)).alias("expected_total"))


def delivered_check(delivered: DataFrame, rows: DataFrame, value_col: str) -> DataFrame:
    """One row (breakdown_sum, expected_total, ok): whether a delivered (key, value) frame adds up to the total of the
    table it is said to come from. Unlike `verify_breakdown` it looks at the result as it was handed over."""
    parts = delivered.agg(F.sum(F.col("value").cast("double")).alias("breakdown_sum"))
    both = parts.withColumn("expected_total", source_total(rows, value_col).scalar())
    close = close_to(F.coalesce("breakdown_sum", F.lit(0.0)), F.col("expected_total"))
    return both.withColumn("ok", (F.col("expected_total") == 0) | close)


def fingerprint(rows: DataFrame) -> list[Column]:
    """Aggregates (rows, fingerprint) that tell one result from another, whatever the order of its rows."""
    each = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]))).cast("decimal(38,0)")
    return [F.count("*").alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("fingerprint")]


def as_checked(delivered: DataFrame, check: Mapping[str, object]) -> bool:
    """Are the rows still those that a check of `PlanRun.deliver` was made on? Runs the frame once."""
    return delivered.agg(*fingerprint(delivered)).first().asDict() == {name: check[name] for name in ("rows", "fingerprint")}


def result_flags(results: DataFrame) -> DataFrame:
    """Adds `flags` to step results (target, value, source_rows, breakdown_sum, expected_total, truncated).

    Columns a result does not have may be absent; their checks then say nothing.
    """
    target = F.lower(F.coalesce(F.col("target"), F.lit("")))
    have = set(results.columns)
    of = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    value, rows = of("value", "double"), of("source_rows", "double")
    parts, total = of("breakdown_sum", "double"), of("expected_total", "double")
    money = F.lit(False)
    for word in MONEY_TARGETS:
        money = money | target.contains(word)
    hits = [
        target.contains("count") & (value > rows),
        (value < 0) & money,
        (total != 0) & ~close_to(parts, total),
        of("truncated", "boolean"),
    ]
    flags = [
        F.when(F.coalesce(hit, F.lit(False)), F.concat(F.lit(f"{kind}:"), target)) for hit, kind in zip(hits, FLAG_KINDS)
    ]
    return results.withColumn("flags", F.array_compact(F.array(*flags)))


def with_confidence(results: DataFrame) -> DataFrame:
    """Adds `confidence` and `passed` to flagged results with `plan_type`, `error` and `parse_failed`."""
    have = set(results.columns)
    broken = F.col("error").isNotNull() & (F.col("error") != "") if "error" in have else F.lit(False)
    if "parse_failed" in have:
        broken = broken | F.coalesce(F.col("parse_failed"), F.lit(False))
    flagged = F.size("flags") > 0
    confidence = (
        F.when(broken | flagged, F.lit("low")).when(F.col("plan_type") == "single_metric", F.lit("high")).otherwise(F.lit("medium"))
    )
    return results.withColumns({"confidence": confidence, "passed": ~broken & ~flagged})


def verify_plan_results(results: DataFrame, plan_col: str = "plan_id") -> DataFrame:
    """(plan, plan_type, n_flags, kinds, confidence, passed); one bad step makes its plan low.

    `kinds` names the checks that failed, of which there are four: nothing is collected that grows with the steps.
    """
    steps = result_flags(results)
    raised = lambda kind: F.bool_or(F.exists("flags", lambda f: f.startswith(kind + ":")))
    kinds = [F.when(raised(kind), F.lit(kind)) for kind in FLAG_KINDS]
    have = set(steps.columns)
    error = F.col("error").isNotNull() & (F.col("error") != "") if "error" in have else F.lit(False)
    parse = F.coalesce(F.col("parse_failed"), F.lit(False)) if "parse_failed" in have else F.lit(False)
    plans = steps.groupBy(plan_col, "plan_type").agg(
        F.sum(F.size("flags")).alias("n_flags"),
        F.array_compact(F.array(*kinds)).alias("flags"),
        F.when(F.bool_or(error), F.lit("step error")).alias("error"),
        F.bool_or(parse).alias("parse_failed"),
    )
    return with_confidence(plans).withColumnRenamed("flags", "kinds").drop("error", "parse_failed")


def small_result(df: DataFrame) -> bool:
    """Has the result fewer than three rows? Reads at most three."""
    return len(df.limit(SMALL_RESULT).take(SMALL_RESULT)) < SMALL_RESULT


def downgrade_small(confidence: str, small: bool) -> tuple[str, list[str]]:
    """Confidence and caveats after the small-result rule: high becomes low on a small result."""
    return ("low", [SMALL_RESULT_CAVEAT]) if small and confidence == "high" else (confidence, [])


def with_lineage(results: DataFrame, targets: Sequence[str], filters: Mapping[str, object] | None = None, notes: str = "") -> DataFrame:
    """Adds a `lineage` struct: metrics and tools used, filters applied, notes."""
    pairs = [part for k, v in (filters or {}).items() for part in (F.lit(k), F.lit(str(v)))]
    applied = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    lineage = F.struct(
        F.array(*[F.lit(t) for t in targets]).cast("array<string>").alias("metrics_or_tools_used"),
        applied.alias("filters_applied"),
        F.lit(notes).alias("notes"),
    )
    return results.withColumn("lineage", lineage)

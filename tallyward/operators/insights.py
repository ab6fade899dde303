"""Automatic insights and the baseline report of a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.frames import small_frame
from tallyward.functions.numbers import correlation_strength, grouped_number
from tallyward.operators import stats
from tallyward.operators.guards import additive_sql, column_ref, identifier, inline_rows, is_numeric_type, number_sql, require_columns, require_numeric, text_literal
from tallyward.operators.metrics import run_metric
from tallyward.operators.profile import TableProfile, value_cell
from tallyward.plans.catalog import MetricDefinition

# ---- Fixed values: thresholds, caps and wording ---------------------------------------------------------
MAX_INSIGHTS = 4
NULL_THRESHOLD = 0.05
CORRELATION_THRESHOLD = 0.5
REPORT_VALUES = 8
OUTLIER_TITLE, OUTLIER_DETAIL = "Outliers found in {column}", "%d statistical outlier(s) detected."
TREND_TITLE, TREND_DETAIL = "{column} trend over {date}", "See chart for movement over time."
BREAKDOWN_TITLE, BREAKDOWN_DETAIL = "Breakdown by {column}", "%s leads at %s."
MISSING_TITLE, MISSING_DETAIL = "%s has missing values", "%.1f%% of rows are missing %s."
CORRELATION_TITLE, CORRELATION_DETAIL = "%s and %s are correlated", "Correlation of %.2f."
# ---------------------------------------------------------------------------------------------------------

# Kinds of the cells of a report, and its sections of which only the first lines are told.
ROWS, COLUMN, GROUP, PERIOD = range(4)
RANKED = ("distribution", "top segment")


def _insight(frame: DataFrame, severity: str, check_no: int, kind: str, title: Column, detail: Column, position: Column | None = None) -> DataFrame:
    return frame.select(
        F.lit(severity).alias("severity"), F.lit(check_no).alias("check_no"),
        (F.lit(0) if position is None else position).cast("int").alias("position"),
        F.lit(kind).alias("type"), title.alias("title"), detail.alias("detail"),
    )


def outlier_insight(df: DataFrame, column: str) -> DataFrame:
    """At most one row: how many outliers the column has."""
    found = stats.outlier_scores(df, column).agg(F.count("*").alias("n")).where("n > 0")
    title = F.lit(OUTLIER_TITLE.format(column=column))
    return _insight(found, "notice", 1, "outlier", title, F.format_string(OUTLIER_DETAIL, "n"))


def trend_insight(df: DataFrame, date_col: str, column: str) -> DataFrame:
    """At most one row: there is a daily series to look at."""
    # Text in a column called a date may not be one; such a row is no reason to fail the whole list.
    # One dated row is enough to know; the scan ends with it.
    require_columns(df, [date_col, column])
    require_numeric(df, [column])
    series = df.where(stats.period_of(df, date_col, "D", lenient=True).isNotNull()).select(column_ref(date_col)).limit(1)
    title = F.lit(TREND_TITLE.format(column=column, date=date_col))
    return _insight(series, "info", 2, "trend", title, F.lit(TREND_DETAIL))


def leader(breakdown: DataFrame) -> DataFrame:
    """(key, value) of the largest group; of equal ones the first key."""
    return breakdown.where(F.col("value").isNotNull()).orderBy(F.desc("value"), F.asc_nulls_last("key")).limit(1)


def breakdown_insight(df: DataFrame, metric: MetricDefinition) -> DataFrame:
    """At most one row: which group leads."""
    key = F.coalesce(F.col("key").cast("string"), F.lit("None"))
    detail = F.format_string(BREAKDOWN_DETAIL, key, grouped_number(F.col("value")))
    title = F.lit(BREAKDOWN_TITLE.format(column=metric.groupby))
    return _insight(leader(run_metric(df, metric)), "info", 3, "breakdown", title, detail)


def missing_insight(profile: DataFrame, threshold: float = NULL_THRESHOLD) -> DataFrame:
    """One row per column with too many nulls."""
    share = F.col("n_null") / F.col("n_rows")
    gaps = profile.where((F.col("n_rows") > 0) & (share > threshold))
    title, detail = F.format_string(MISSING_TITLE, "name"), F.format_string(MISSING_DETAIL, share * 100, "name")
    return _insight(gaps, "notice", 4, "missingness", title, detail, F.col("ordinal"))


def correlation_insight(df: DataFrame, columns: list[str], threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """At most one row: the strongest pair, when it is strong enough."""
    pair = stats.strongest_pair(df, columns).where(F.abs("r") > threshold)
    title, detail = F.format_string(CORRELATION_TITLE, "row", "col"), F.format_string(CORRELATION_DETAIL, "r")
    return _insight(pair, "info", 5, "correlation", title, detail)


def breakdown_metric(metrics: Mapping[str, MetricDefinition], group: str) -> MetricDefinition | None:
    """The first metric of the catalog grouped by a column."""
    return next((m for m in metrics.values() if m.groupby == group), None)


def insights(
    df: DataFrame,
    profile: TableProfile,
    profile_rows: DataFrame,
    metrics: Mapping[str, MetricDefinition],
    limit: int = MAX_INSIGHTS,
) -> DataFrame:
    """The most important findings, notices before infos, in the order of the checks.

    A check that can not be built for this table is left out without stopping the others.
    """
    numeric, temporal, groups = profile.numeric, profile.temporal, profile.categorical
    checks: list[Callable[[], DataFrame]] = [lambda: missing_insight(profile_rows)]
    if numeric:
        checks.append(lambda: outlier_insight(df, numeric[0]))
    if numeric and temporal:
        checks.append(lambda: trend_insight(df, temporal[0], numeric[0]))
    if groups and breakdown_metric(metrics, groups[0]):
        checks.append(lambda: breakdown_insight(df, breakdown_metric(metrics, groups[0])))
    if len(numeric) >= 2:
        checks.append(lambda: correlation_insight(df, numeric))
    found = []
    for check in checks:
        try:
            found.append(check())
        except ValueError:
            continue
    rank = F.when(F.col("severity") == "notice", 0).otherwise(1)
    return reduce(DataFrame.unionByName, found).orderBy(rank, "check_no", "position").limit(limit)


def _two_decimals(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f", value.cast("double")))


def _report_cells(df: DataFrame, profile: TableProfile) -> DataFrame:
    """The cells of a report, aggregated by what they are about, from one scan.

    `kind` is ROWS (once a row, with the first two numeric columns as x and y), COLUMN (a cell for each column: x of a numeric
    one, the value of another in the slot of its type, see `profile.value_cell`), GROUP (the first grouping column's value in
    `key`) or PERIOD (the month); `v` is what a group or a month sums up.
    """
    numeric, temporal, groups = profile.numeric, profile.temporal, profile.categorical
    key = identifier(groups[0]) if groups else "CAST(NULL AS STRING)"
    key_type = df.schema[groups[0]].dataType.simpleString() if groups else "string"
    v = additive_sql(df, numeric[0]) if numeric else "CAST(NULL AS DOUBLE)"
    none = {
        "kind": "-1", "place": "0", "key": f"CAST(NULL AS {key_type})", "period": "CAST(NULL AS DATE)", "whole": "CAST(NULL AS BIGINT)",
        "fraction": "CAST(NULL AS DOUBLE)", "text": "CAST(NULL AS STRING)", "x": "CAST(NULL AS DOUBLE)", "y": "CAST(NULL AS DOUBLE)",
        "v": f"IF(false, {v}, NULL)",
    }
    as_double = lambda name: f"CAST({number_sql(df, name)} AS DOUBLE)"
    pair = {}
    if len(numeric) >= 2:
        a, b = map(as_double, numeric[:2])
        pair = {"x": f"IF({b} IS NULL, NULL, {a})", "y": f"IF({a} IS NULL, NULL, {b})"}
    cells = [{**none, "kind": str(ROWS), **pair}]
    for place, name in enumerate(df.columns, 1):
        value = {"x": as_double(name)} if is_numeric_type(df.schema[name].dataType) else value_cell(df, name)
        cells.append({**none, "kind": str(COLUMN), "place": str(place), **value})
    if groups:
        cells.append({**none, "kind": str(GROUP), "key": key, **({"v": v} if numeric else {})})
    if numeric and temporal:
        # Text in a column called a date may not be one; such a row has no month and is left out below.
        month = f"trunc(try_cast({identifier(temporal[0])} AS DATE), '{stats.PERIODS['M']}')"
        cells.append({**none, "kind": str(PERIOD), "period": month, "v": v})
    rows = df.select(inline_rows(cells)).where(f"kind != {PERIOD} OR period IS NOT NULL")
    sums = rows.groupBy("kind", "place", "key", "period", "whole", "fraction", "text").agg(
        F.count("*").alias("n"), F.count("x").alias("nx"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"), F.stddev_samp("y").alias("std_y"), F.covar_samp("x", "y").alias("covar"), F.sum("v").alias("v"),
    )
    # A row that counts nothing for the table and each column, so that an empty table has them too.
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema)
    every = [{"kind": ROWS, "place": 0}, *({"kind": COLUMN, "place": i} for i in range(1, len(df.columns) + 1))]
    padded = sums.unionByName(small_frame(df.sparkSession, [{**e, "n": 0, "nx": 0} for e in every], shape))
    missing = F.col("whole").isNull() & F.col("fraction").isNull() & F.col("text").isNull()
    return padded.groupBy("kind", "place", "key", "period").agg(
        F.sum("n").alias("n"), F.sum("nx").alias("nx"), F.count_if(~missing).alias("n_unique"),
        F.sum(F.when(missing, F.col("n")).otherwise(F.lit(0))).alias("n_missing"),
        *[F.max(c).alias(c) for c in ("mean", "std", "min", "max", "std_y", "covar", "v")],
    )


def baseline_report(df: DataFrame, profile: TableProfile) -> DataFrame:
    """(section, position, label, value): overview, key findings, statistics, gaps, top values, monthly trend.

    Within a section rows are ordered by position, then label. All of it is one aggregation over one scan but for the count of
    outliers, which has to know the mean first.
    """
    numeric, temporal, groups = profile.numeric, profile.temporal, profile.categorical
    nothing, number_of = F.lit(None), lambda c: F.col(c).cast("string")
    key_type, v_type = (lambda t: (t["key"].dataType, t["v"].dataType))((cells := _report_cells(df, profile)).schema)

    def line(section: str, position: Column, label: Column, value: Column, keep: Column = F.lit(True), best: Column = nothing, most: Column = nothing) -> Column:
        ranked = section in RANKED
        return F.struct(
            F.lit(section).alias("section"), position.cast("int").alias("position"), label.cast("string").alias("label"),
            value.cast("string").alias("value"), keep.alias("keep"), F.lit(ranked).alias("ranked"),
            (F.col("key") if ranked else nothing).cast(key_type).alias("key"), best.cast(v_type).alias("best"), most.cast("long").alias("most"),
        )

    table = [line("overview", F.lit(0), F.lit("rows"), F.col("n")), line("overview", F.lit(1), F.lit("columns"), F.lit(profile.n_cols))]
    if len(numeric) >= 2:
        spread = F.col("std") * F.col("std_y")
        r = F.when(spread > 0, F.col("covar") / spread).otherwise(F.lit(0.0))
        table.append(line("correlation", F.lit(0), correlation_strength(r), F.format_string("%+.2f", r)))
    is_number = F.expr(f"get(array({', '.join(str(is_numeric_type(f.dataType)).lower() for f in df.schema)}), place - 1)")
    name = F.expr(f"get(array({', '.join(map(text_literal, df.columns))}), place - 1)")
    nulls = F.when(is_number, F.col("n") - F.col("nx")).otherwise(F.col("n_missing"))
    facts = {
        "count": (F.col("n") - nulls).cast("string"), "nulls": nulls.cast("string"),
        "n_unique": F.when(~is_number, number_of("n_unique")), **{m: _two_decimals(F.col(m)) for m in ("mean", "std", "min", "max")},
    }
    column = [line("statistics", F.col("place"), F.concat_ws(".", name, F.lit(f)), x, x.isNotNull()) for f, x in facts.items()]
    column.append(line("missing", F.col("place"), name, nulls, nulls > 0))
    group = [line("distribution", F.lit(0), F.col("key"), F.col("n"), most=F.col("n"))]
    if numeric:
        group.append(line("top segment", F.lit(0), F.col("key"), grouped_number(F.col("v")), F.col("v").isNotNull(), best=F.col("v")))
    lines = F.when(F.col("kind") == ROWS, F.array(*table)).when(F.col("kind") == COLUMN, F.array(*column)).when(F.col("kind") == GROUP, F.array(*group))
    lines = lines.otherwise(F.array(line("trend", F.lit(0), F.col("period"), _two_decimals(F.col("v")))))
    said = cells.select(F.inline(lines)).where("keep")
    # Only the two ranked sections are put in order; every other line is first of its own.
    own = F.when(~F.col("ranked"), F.concat_ws("\0", F.col("position").cast("string"), "label"))
    order = Window.partitionBy("section", own).orderBy(F.desc("best"), F.desc("most"), F.asc_nulls_last("key"))
    placed = said.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= REPORT_VALUES)
    placed = placed.where((F.col("section") != "top segment") | (F.col("rank") == 1))
    position = F.when(F.col("section") == "distribution", F.col("rank")).otherwise(F.col("position"))
    report = placed.select("section", position.alias("position"), "label", "value")
    if not numeric:
        return report
    found = stats.outlier_scores(df, numeric[0]).agg(F.count("*").alias("n")).where("n > 0")
    return report.unionByName(
        found.select(F.lit("outliers").alias("section"), F.lit(0).alias("position"), F.lit(numeric[0]).alias("label"), number_of("n").alias("value"))
    )

"""The seven fixed statistics tools, each one scan of the table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import isfinite
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.frames import small_frame
from tallyward.functions.numbers import percent, z_score
from tallyward.operators.guards import (
    additive,
    column_ref,
    inline_rows,
    is_numeric_type,
    number,
    number_sql,
    one_row_each,
    require_columns,
    require_numeric,
    text_literal,
    value_sql,
)
from tallyward.operators.profile import column_counts

# Limits and names of the tools' options.
TOP_VALUES = 10
ANOMALY_THRESHOLD = 2.0
ANOMALY_ROWS = 20
# Columns of a group of the correlation matrix: bounds the aggregates of its one aggregation.
MATRIX_WIDTH = 8
# Rows looked at to find about the middle of the columns' values.
MATRIX_LOOK = 100
PERIODS = {"M": "MM", "W": "WEEK", "D": None}
GROUP_AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def describe(df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "exact") -> DataFrame:
    """(column, dtype, count, mean, std, min, max, nulls, n_unique), one row per column in table order.

    Numeric columns get the statistics, the others their distinct count.
    """
    names = list(df.columns if columns is None else columns)
    require_columns(df, names)
    numeric = [c for c in names if is_numeric_type(df.schema[c].dataType)]
    other = [c for c in names if c not in numeric]
    parts = []
    if numeric:
        parts.append(_describe_numbers(df, numeric))
    if other:
        counts = column_counts(df, other, distinct)
        parts.append(
            counts.select(
                F.col("name").alias("column"), F.lit("categorical").alias("dtype"),
                (F.col("n_rows") - F.col("n_null")).alias("count"),
                *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "max")],
                F.col("n_null").alias("nulls"), F.col("n_unique"),
            )
        )
    result = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("column"))
    return result.orderBy(place)


def _describe_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    # A cell per column, aggregated by column: six aggregates whatever the width, so that generated code stays small.
    cells = df.select(
        inline_rows([{"column": text_literal(n), "x": f"CAST({number_sql(df, n)} AS DOUBLE)"} for n in names])
    )
    found = cells.groupBy("column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"), (F.count("*") - F.count("x")).alias("nulls"),
    )
    rows = _with_every(found, "column", [(n,) for n in names])
    return rows.select(
        "column", F.lit("numeric").alias("dtype"), F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "max",
        F.coalesce("nulls", F.lit(0)).alias("nulls"), F.lit(None).cast("bigint").alias("n_unique"),
    )


def _with_every(found: DataFrame, keys: str, wanted: Sequence[tuple]) -> DataFrame:
    """A small result with a row of nulls for every wanted key it lacks, as a table without rows leaves no cells."""
    names = keys.split()
    kinds = ", ".join(f"{n} {found.schema[n].dataType.simpleString()}" for n in names)
    every = small_frame(found.sparkSession, [dict(zip(names, w)) for w in wanted], kinds)
    return every.join(found, names, "left")


def value_counts(df: DataFrame, column: str, top_n: int = TOP_VALUES) -> DataFrame:
    """(value, count, pct): the most frequent values, null being one; pct is of all rows.

    The counts are pre-aggregated before the shuffle, and the total is a one-row subquery over them, so a
    column with very many values never meets in one task.
    """
    require_columns(df, [column])
    top = TOP_VALUES if top_n < 1 else int(top_n)
    counts = df.groupBy(column_ref(column).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    best = counts.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(top)
    return best.withColumn("pct", percent(F.col("count"), total))


def _pearson(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present; 0.0 where a side does not vary, which `corr` would fail on."""
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(spread > 0, F.covar_samp(x, y) / spread).otherwise(F.lit(0.0))


def _block_moments(cells: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(a, b, i, j, _r): Pearson r of pairs of the named columns in each block, null where it is undefined."""
    pattern = " + ".join(f"IF({n} IS NULL, {1 << k}, 0)" for k, n in enumerate(names))
    filled = cells.selectExpr("a", "b", f"{pattern} AS pattern", *names, *[f"coalesce({n}, 0D) AS _{n}" for n in names])
    used = sorted({k for pair in pairs for k in pair})
    sums = [F.count("*").alias("n")]
    sums += [F.expr(f"{f} AS {f[:3]}{k}") for k in used for f in (f"sum(_{names[k]})", f"min({names[k]})", f"max({names[k]})")]
    sums += [F.expr(f"sum(_{names[i]} * _{names[j]}) AS p{i}_{j}") for i, j in [*[(k, k) for k in used], *pairs]]
    found = filled.groupBy("a", "b", "pattern").agg(*sums)
    cell = lambda i, j: (
        f"struct({i} AS i, {j} AS j, n, sum{i} AS x, sum{j} AS y, p{i}_{i} AS xx, p{j}_{j} AS yy, p{i}_{j} AS xy, "
        f"min{i} AS x0, max{i} AS x1, min{j} AS y0, max{j} AS y1, pattern & {1 << i | 1 << j} AS gaps)"
    )
    each = found.selectExpr("a", "b", f"inline(array({', '.join(cell(i, j) for i, j in pairs)}))").where("gaps = 0")
    whole = each.groupBy("a", "b", "i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")], *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")]
    )
    spread = "sqrt(greatest(xx - x * x / n, 0D)) * sqrt(greatest(yy - y * y / n, 0D))"
    r = f"CASE WHEN x0 < x1 AND y0 < y1 AND {spread} > 0 THEN greatest(-1D, least(1D, (xy - x * y / n) / ({spread}))) END"
    return whole.selectExpr("a", "b", "i", "j", f"{r} AS _r")


def correlation(df: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """One row (corr); 0.0 where the correlation is undefined."""
    require_numeric(df, [col_a, col_b])
    both = df.select(number(df, col_a).cast("double").alias("x"), number(df, col_b).cast("double").alias("y")).dropna()
    return both.agg(_pearson(F.col("x"), F.col("y")).alias("corr"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Long matrix (row, col, r) over the named columns, by default all numeric ones, from one scan.

    Columns are taken in groups of MATRIX_WIDTH, and each two groups are a block of pairs. A table of one group is aggregated as it
    is; of a wider one a row gives a cell for each block, so that the number of aggregates is that of a block, whatever the width.
    A block's rows are summed up by which of its columns are null, as plain sums, squares and products; a pair's moments are those
    of all patterns in which it has both values. `limit` keeps the first columns only.

    Values are taken from about their middle, so that the products do not cancel out; a job of a few rows finds out where that is.
    """
    numeric = [c for c in df.columns if is_numeric_type(df.schema[c].dataType)] if columns is None else list(columns)
    names = numeric if limit is None else numeric[:limit]
    require_numeric(df, names)
    values = df.selectExpr(*[f"CAST({number_sql(df, n)} AS DOUBLE) AS x{i}" for i, n in enumerate(names)])
    first = values.limit(MATRIX_LOOK).collect() if names else []
    middles = [median([v for v in column if v is not None and isfinite(v)] or [0.0]) for column in zip(*first)] or [0.0] * len(names)
    values = values.selectExpr(*[f"x{i} - ({middle!r}D) AS x{i}" for i, middle in enumerate(middles)])
    starts = range(0, max(len(names), 1), MATRIX_WIDTH)
    of = lambda at, side: {f"{side}{k}": f"x{at + k}" if at + k < len(names) else "CAST(NULL AS DOUBLE)" for k in range(MATRIX_WIDTH)}
    if len(starts) == 1:
        cells = values.selectExpr("0 AS a", "0 AS b", *[f"{value} AS {name}" for name, value in of(0, "x").items()])
        sums = _block_moments(cells, [f"x{k}" for k in range(MATRIX_WIDTH)], [(i, j) for i in range(MATRIX_WIDTH) for j in range(i + 1, MATRIX_WIDTH)])
        pairs = sums.selectExpr("i", "j", "_r")
    else:
        cells = values.select(inline_rows([{"a": str(a), "b": str(b), **of(a, "x"), **of(b, "y")} for a in starts for b in starts if a <= b]))
        sides = [f"{side}{k}" for side in "xy" for k in range(MATRIX_WIDTH)]
        sums = _block_moments(cells, sides, [(i, MATRIX_WIDTH + j) for i in range(MATRIX_WIDTH) for j in range(MATRIX_WIDTH)])
        pairs = sums.selectExpr("a + i AS i", f"b + j - {MATRIX_WIDTH} AS j", "_r").where("i < j")
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.coalesce("_r", F.lit(0.0)))
    wanted = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    triangle = _with_every(pairs, "i j", wanted).select("i", "j", r.alias("r"))
    mirrored = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("r"))
    both_ways = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", "r"))).otherwise(F.array(F.struct("i", "j", "r"), mirrored))
    listed = ", ".join(map(text_literal, names))
    return triangle.select(F.inline(both_ways)).selectExpr(f"get(array({listed}), i) AS row", f"get(array({listed}), j) AS col", "r")


def strongest_pair(df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """(row, col, r) of the largest |r|; of equal ones the pair that comes first in table order."""
    numeric = [c for c in df.columns if is_numeric_type(df.schema[c].dataType)] if columns is None else list(columns)
    place = F.array(*[F.lit(n) for n in numeric])
    matrix = correlation_matrix(df, columns, limit).where(F.col("row") != F.col("col"))
    return matrix.orderBy(
        F.desc(F.abs("r")), F.array_position(place, F.col("row")), F.array_position(place, F.col("col"))
    ).limit(1)


def group_compare(df: DataFrame, value_col: str, group_col: str, agg: str = "sum") -> DataFrame:
    """(key, value) by descending value."""
    require_columns(df, [value_col, group_col])
    require_numeric(df, [value_col])
    function = GROUP_AGGREGATES.get(agg.lower())
    if function is None:
        raise ValueError(f"agg must be one of {sorted(GROUP_AGGREGATES)}")
    value = function(additive(df, value_col) if agg.lower() == "sum" else number(df, value_col)).alias("value")
    grouped = df.groupBy(column_ref(group_col).alias("key")).agg(value)
    return grouped.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("key"))


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, total, nulls, null_pct), one row per column in the order given; one aggregation."""
    names = list(df.columns if columns is None else columns)
    require_columns(df, names)
    rows = [
        {"column": f"any_value({text_literal(c)})", "total": "count(*)", "nulls": f"count(*) - count({value_sql(df, c)})"}
        for c in names
    ]
    counts = one_row_each(df, rows)
    return counts.withColumn("null_pct", percent(F.col("nulls"), F.col("total")))


def period_of(df: DataFrame, date_col: str, freq: str = "M", lenient: bool = False) -> Column:
    """First day of the month, Monday of the week, or the day, as a date."""
    if freq not in PERIODS:
        raise ValueError(f"freq must be one of {sorted(PERIODS)}")
    column = column_ref(date_col)
    day = column.try_cast("date") if lenient else column.cast("date")
    return F.trunc(day, PERIODS[freq]) if PERIODS[freq] else day


def trend(df: DataFrame, date_col: str, value_col: str, freq: str = "M", lenient: bool = False) -> DataFrame:
    """(period, value, n) in time order: sum and row count per period; rows without a date are left out.

    `lenient` leaves out text that is no date instead of failing on it.
    """
    require_columns(df, [date_col, value_col])
    require_numeric(df, [value_col])
    period = period_of(df, date_col, freq, lenient)
    dated = df.where(column_ref(date_col).isNotNull())
    if lenient:
        dated = dated.where(period.isNotNull())
    sums = dated.groupBy(period.alias("period")).agg(
        F.sum(additive(df, value_col)).alias("value"), F.count("*").alias("n")
    )
    return sums.orderBy("period")


def outlier_scores(df: DataFrame, value_col: str, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Every row at least `threshold` standard deviations from the mean, with mean_val, std_val and z_score.

    Mean and deviation are a one-row subquery run before the scan, so the second pass is a plain filter.
    """
    require_numeric(df, [value_col])
    value = number(df, value_col)
    moments = df.agg(F.avg(value).cast("double").alias("mean"), F.stddev_samp(value).alias("std"))
    spread = moments.select(F.struct("mean", "std").alias("m")).scalar()
    scored = df.withColumn("_m", spread)
    mean, std = F.col("_m.mean"), F.col("_m.std")
    score = z_score(value, mean, std)
    return (
        scored.where(F.abs(score) >= F.lit(float(threshold)))
        .withColumns({"mean_val": mean, "std_val": std, "z_score": F.round(score, 2)})
        .drop("_m")
    )


def anomaly_detect(
    df: DataFrame,
    value_col: str,
    threshold: float = ANOMALY_THRESHOLD,
    limit: int = ANOMALY_ROWS,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The most extreme rows by |z_score|. Name unique `tiebreak` columns for a repeatable choice among ties."""
    scored = outlier_scores(df, value_col, threshold)
    return scored.orderBy(F.desc(F.abs("z_score")), *[column_ref(c) for c in tiebreak]).limit(limit)


# ---- dispatch -------------------------------------------------------------------------------------------

TOOLS: dict[str, Callable[..., DataFrame]] = {
    "describe": describe,
    "value_counts": value_counts,
    "correlation": correlation,
    "group_compare": group_compare,
    "missingness": missingness,
    "trend": trend,
    "anomaly_detect": anomaly_detect,
}


def run_tool(df: DataFrame, tool: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """Run a tool of the allowlist by name.

    An outlier search without a column looks at the first numeric column that is no identifier.
    """
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool!r}; allowed: {sorted(TOOLS)}")
    options = dict(args or {})
    if tool == "anomaly_detect" and "value_col" not in options:
        options["value_col"] = default_measure(df)
    return TOOLS[tool](df, **options)


def default_measure(df: DataFrame) -> str:
    """The first numeric column that is no identifier."""
    from tallyward.plans.catalog import is_id_like

    for name in df.columns:
        if is_numeric_type(df.schema[name].dataType) and not is_id_like(name):
            return name
    raise ValueError("no numeric column")

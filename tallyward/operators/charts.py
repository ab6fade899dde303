"""Chart-ready data: the first points of a result and whether any were cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.numbers import looks_like_date
from tallyward.operators.guards import cap_rows

# Points of a chart; groups of a breakdown that all have to look like dates for it to be a series.
MAX_POINTS = 50
DATE_GROUPS = 5


def bar_data(breakdown: DataFrame, points: int = MAX_POINTS) -> DataFrame:
    """(category, value, truncated) from (key, value), largest first."""
    bars = breakdown.select(F.col("key").cast("string").alias("category"), "value")
    return cap_rows(bars, points, [F.desc_nulls_last("value"), F.asc_nulls_last("category")])


def breakdown_data(breakdown: DataFrame, points: int = MAX_POINTS) -> DataFrame:
    """(kind, category, value, truncated) from (key, value): a line in the order of its keys if the largest groups look like dates,
    else bars, largest first. An empty breakdown has no rows."""
    largest = breakdown.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("key")).limit(DATE_GROUPS)
    dated = largest.agg(F.bool_and(F.coalesce(looks_like_date(F.col("key")), F.lit(False))))
    kind = F.when(dated.scalar(), "line").otherwise("bar")
    rows = breakdown.select(kind.alias("kind"), F.col("key").cast("string").alias("category"), "value")
    in_time = F.when(F.col("kind") == "line", F.col("category"))
    return cap_rows(rows, points, [F.asc_nulls_last(in_time), F.desc_nulls_last("value"), F.asc_nulls_last("category")])


def line_data(series: DataFrame, points: int = MAX_POINTS, date_col: str = "period") -> DataFrame:
    """(date, value, truncated) in time order."""
    line = series.select(F.col(date_col).cast("string").alias("date"), "value")
    return cap_rows(line, points, [F.asc_nulls_last("date")])


def heatmap_data(matrix: DataFrame) -> DataFrame:
    """(row, col, value) from a long correlation matrix."""
    return matrix.select("row", "col", F.col("r").alias("value"))

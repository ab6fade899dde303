"""Exact interpolated percentiles that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.operators.guards import column_ref, number

# A sketch places GRID + 1 fence values; its rank error is a tenth of the distance between two of them. Sketches
# stay small on purpose: those of all tasks meet in one task per group. A second pass narrows further instead.
GRID = 200
ACCURACY = 2_000
FENCES = [i / GRID for i in range(GRID + 1)]
# A pass leaves about this part of a group between the fences; passes are made until the largest group has at most
# SORTED values left to sort.
NARROWING = 40
SORTED = 500_000
# Fences of up to this many groups are sent to all tasks; those of more are joined.
SENT_GROUPS = 10_000


def percentile_summary(
    df: DataFrame, keys: Sequence[str], value_col: str, percents: Sequence[float] = (50, 95), sorted_values: int = SORTED
) -> DataFrame:
    """(keys, n, mean, p<percent> …) with linear interpolation between the two neighbouring ranks.

    The built-in `percentile` keeps every distinct value of a group in one aggregation buffer. Here a sketch
    fences in the wanted ranks, about a fortieth of a group at each pass; values below the fence are only
    counted, and just the distinct values between the last fences are sorted. The result is exact whatever the
    sketch's error, as the fences lie beyond its bound. Each pass is a scan, and their number follows from the rows
    of the largest group, which are counted by a job when the frame is built.
    """
    groups = list(keys) or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    measured = source.select(*[column_ref(k) for k in groups], number(df, value_col).cast("double").alias("_v"))
    measured = measured.where(F.col("_v").isNotNull())
    sizes = measured.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("largest")).first()
    send = sizes["groups"] <= SENT_GROUPS
    brackets = _first_brackets(measured, groups, percents)
    left = (sizes["largest"] or 0) / NARROWING
    while left > sorted_values:
        brackets = _narrowed(measured, brackets, groups, send)
        left /= NARROWING
    inside = F.when(F.col("_v") >= F.col("b.start"), F.col("_v"))
    counted = _paired(measured, brackets, groups, send).groupBy(*groups, "b", inside.alias("_value")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*groups, "b").orderBy(F.asc_nulls_first("_value"))
    ranked = counted.withColumn("_upto", F.sum("_n").over(upto))
    ends = ranked.groupBy(*groups, "b").agg(
        F.min(F.when(F.col("_upto") > F.col("b.low"), F.col("_value"))).alias("_low"),
        F.min(F.when(F.col("_upto") > F.col("b.high"), F.col("_value"))).alias("_high"),
    )
    exact = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("b.part")
    return ends.groupBy(*groups).agg(
        F.max("b.n").alias("n"), F.max("b.mean").alias("mean"),
        *[F.max(F.when(F.col("b.i") == i, exact)).alias(f"p{percent:g}") for i, percent in enumerate(percents)],
    ).drop("_all")


def _first_brackets(measured: DataFrame, groups: Sequence[str], percents: Sequence[float]) -> DataFrame:
    sketch = measured.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"), F.percentile_approx("_v", FENCES, ACCURACY).alias("_fences")
    )
    wanted = [F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(p / 100.0)).alias("rank")) for i, p in enumerate(percents)]
    ranks = sketch.withColumn("_w", F.explode(F.array(*wanted)))
    low = F.floor("_w.rank")
    high = F.least(low + 1, F.col("n") - 1)
    start, end = _fence(F.col("_fences"), low, high, F.col("n"))
    bracket = F.struct(
        F.col("_w.i").alias("i"), "n", "mean", low.alias("low"), high.alias("high"), (F.col("_w.rank") - low).alias("part"),
        start.alias("start"), end.alias("end"),
    )
    return ranks.select(*groups, bracket.alias("b"))


def _narrowed(measured: DataFrame, brackets: DataFrame, groups: Sequence[str], send: bool) -> DataFrame:
    """The same ranks fenced in by a sketch of the values between the present fences only."""
    inside = F.when(F.col("_v") >= F.col("b.start"), F.col("_v"))
    sketch = _paired(measured, brackets, groups, send).groupBy(*groups, "b").agg(
        F.count(inside).alias("_m"), F.count_if(inside.isNull()).alias("_below"),
        F.percentile_approx(inside, FENCES, ACCURACY).alias("_fences"),
    )
    start, end = _fence(F.col("_fences"), F.col("b.low") - F.col("_below"), F.col("b.high") - F.col("_below"), F.col("_m"))
    return sketch.select(*groups, F.col("b").withField("start", start).withField("end", end).alias("b"))


def _fence(fences: Column, low: Column, high: Column, n: Column) -> tuple[Column, Column]:
    # Two fences of slack on each side: one for the sketch's error, one for rounding of ranks.
    first = F.greatest(F.floor(low / n * GRID) - 2, F.lit(0)).cast("int")
    last = F.least(F.ceil((high + 1) / n * GRID) + 2, F.lit(GRID)).cast("int")
    return F.get(fences, first), F.get(fences, last)


def _paired(measured: DataFrame, brackets: DataFrame, groups: Sequence[str], send: bool) -> DataFrame:
    """Every value with the brackets of its group that it is not above."""
    per_group = brackets.groupBy(*groups).agg(F.collect_list("b").alias("_b"))  # one entry per percent
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in groups]
    joined = measured.alias("a").join((F.broadcast(per_group) if send else per_group).alias("c"), same)
    fitting = F.filter("_b", lambda b: F.col("_v") <= b["end"])
    return joined.select(*[F.col(f"a.`{k}`") for k in groups], "_v", F.explode(fitting).alias("b"))


def percentile_sketch(
    df: DataFrame, keys: Sequence[str], value_col: str, percents: Sequence[float] = (50, 95), accuracy: int = 10_000
) -> DataFrame:
    """The same summary with sketched percentiles: one pass, no interpolation, rank error of 1/accuracy."""
    value = number(df, value_col).cast("double")
    fractions = [p / 100.0 for p in percents]
    summary = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, fractions, accuracy).alias("_p")
    )
    return summary.select(*keys, "n", "mean", *[F.get("_p", F.lit(i)).alias(f"p{p:g}") for i, p in enumerate(percents)])

import math

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from tallyward.operators import percentiles, profile, stats
from tests.conftest import values


def test_describe(orders):
    rows = {r["column"]: r for r in stats.describe(orders).collect()}
    assert list(rows) == orders.columns
    revenue = rows["revenue"]
    assert (revenue["count"], round(revenue["mean"], 2), revenue["min"], revenue["max"], revenue["nulls"]) == (6, 233.33, 100.0, 400.0, 0)
    assert revenue["std"] == pytest.approx(np.std([100, 200, 300, 150, 250, 400], ddof=1))
    assert rows["region"]["n_unique"] == 4 and rows["region"]["mean"] is None
    assert stats.describe(orders).columns == ["column", "dtype", "count", "mean", "std", "min", "max", "nulls", "n_unique"]


def test_describe_count_and_nulls_make_all_rows(spark):
    df = spark.createDataFrame([(1.0, None), (None, "a"), (float("nan"), "a")], "x double, s string")
    for row in stats.describe(df).collect():
        assert row["count"] + row["nulls"] == 3


def test_empty_table(orders):
    empty = orders.where("1 = 0")
    rows = {r["column"]: r for r in stats.describe(empty).collect()}
    assert len(rows) == 7 and rows["revenue"]["count"] == 0 and rows["revenue"]["mean"] is None and rows["region"]["n_unique"] == 0
    assert {r["null_pct"] for r in stats.missingness(empty).collect()} == {0.0}
    assert stats.correlation(empty, "revenue", "quantity").first()[0] == 0.0
    assert stats.anomaly_detect(empty, "revenue").count() == 0
    assert stats.value_counts(empty, "region").count() == 0
    assert {r["r"] for r in stats.correlation_matrix(empty).where("row <> col").collect()} == {0.0}
    assert [r["n_rows"] for r in profile.profile_frame(empty).collect()] == [0] * 7


def test_value_counts(orders):
    got = values(stats.value_counts(orders, "region"))
    assert got == [("North", 2, 33.33), ("South", 2, 33.33), ("East", 1, 16.67), ("West", 1, 16.67)]
    assert len(values(stats.value_counts(orders, "region", 2))) == 2
    assert len(values(stats.value_counts(orders, "order_id", 0))) == 6


def test_percentages_round_ties_to_even(spark):
    df = spark.range(800).select(F.when(F.col("id") == 0, "a").otherwise("b").alias("v"))
    assert dict((v, p) for v, _, p in values(stats.value_counts(df, "v")))["a"] == 0.12


def test_correlation(orders):
    assert stats.correlation(orders, "revenue", "revenue").first()[0] == pytest.approx(1.0)
    constant = orders.withColumn("one", F.lit(1))
    assert stats.correlation(constant, "revenue", "one").first()[0] == 0.0
    with pytest.raises(ValueError):
        stats.correlation(orders, "revenue", "region")


def test_matrix_is_symmetric_and_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 3))
    rows = [tuple(float(v) if rng.random() > 0.1 else None for v in row) for row in data]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    matrix = {(r["row"], r["col"]): r["r"] for r in stats.correlation_matrix(df).collect()}
    assert len(matrix) == 9
    for (x, y), r in matrix.items():
        assert abs(r) <= 1 and r == matrix[(y, x)]
        if x == y:
            assert r == 1.0
        else:
            i, j = "abc".index(x), "abc".index(y)
            both = [(row[i], row[j]) for row in rows if row[i] is not None and row[j] is not None]
            assert r == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])
    best = stats.strongest_pair(df).first()
    assert abs(best["r"]) == pytest.approx(max(abs(r) for (x, y), r in matrix.items() if x != y))


def test_matrix_takes_all_columns_unless_told_otherwise(spark):
    df = spark.range(5).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(10)])
    assert stats.correlation_matrix(df).count() == 100
    assert stats.correlation_matrix(df, [f"c{i}" for i in range(9, -1, -1)]).count() == 100
    assert stats.correlation_matrix(df, limit=8).count() == 64


def test_group_compare(orders):
    assert values(stats.group_compare(orders, "revenue", "region"))[:2] == [("South", 600.0), ("North", 400.0)]
    assert dict(values(stats.group_compare(orders, "revenue", "region", "MEAN")))["South"] == 300.0
    with pytest.raises(ValueError):
        stats.group_compare(orders, "revenue", "region", "median")
    with pytest.raises(ValueError):
        stats.group_compare(orders, "region", "category")


def test_missingness(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (3, "b")], "x int, s string")
    assert values(stats.missingness(df)) == [("x", 3, 1, 33.33), ("s", 3, 1, 33.33)]
    assert values(stats.missingness(df, ["s"])) == [("s", 3, 1, 33.33)]


def test_trend(orders):
    assert len(values(stats.trend(orders, "order_date", "revenue", "M"))) == 6
    week = stats.trend(orders, "order_date", "revenue", "W").first()
    assert week["period"].weekday() == 0
    with pytest.raises(ValueError):
        stats.trend(orders, "order_date", "revenue", "Y")


def test_trend_on_dirty_text(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("soon", 2.0), (None, 4.0)], "due_date string, x double")
    assert [(p.isoformat(), v, n) for p, v, n in values(stats.trend(df, "due_date", "x", "M", lenient=True))] == [("2024-01-01", 1.0, 1)]
    with pytest.raises(Exception):
        stats.trend(df, "due_date", "x", "M").collect()


def test_anomaly(spark):
    df = spark.createDataFrame([(i, 1.0 + i % 2) for i in range(40)] + [(99, 100.0)], "i int, revenue double")
    found = stats.anomaly_detect(df, "revenue").collect()
    assert [r["i"] for r in found] == [99] and found[0]["z_score"] == pytest.approx(6.25, abs=0.2)
    assert stats.anomaly_detect(df.select(F.lit(3.0).alias("revenue")), "revenue").count() == 0
    assert stats.anomaly_detect(df, "revenue", 0.0).count() == 20


def test_dispatch(orders):
    with pytest.raises(ValueError, match="unknown tool"):
        stats.run_tool(orders, "drop_table")
    assert len(stats.TOOLS) == 7
    assert stats.run_tool(orders, "anomaly_detect", {"threshold": 1.0}).columns[-1] == "z_score"
    with pytest.raises(ValueError, match="available"):
        stats.run_tool(orders, "value_counts", {"column": "nope"})


@pytest.mark.parametrize("sorted_values", [1_000_000, 30, 1])
@pytest.mark.parametrize("rows", [1, 2, 7, 50, 5000])
def test_percentiles_equal_numpy(spark, rows, sorted_values):
    rng = np.random.default_rng(rows)
    # One group holds most rows; another is all ties; values stretch over many orders of magnitude.
    data = [("hot", float(v)) for v in np.exp(rng.normal(size=rows) * 3)] + [("tied", 5.0)] * 9 + [(None, float(v)) for v in range(4)]
    df = spark.createDataFrame(data, "phase string, ms double")
    got = {r["phase"]: r for r in percentiles.percentile_summary(df, ["phase"], "ms", (50, 95, 99), sorted_values).collect()}
    for phase in ("hot", "tied", None):
        mine = [v for p, v in data if p == phase]
        assert got[phase]["n"] == len(mine) and got[phase]["mean"] == pytest.approx(np.mean(mine))
        for p in (50, 95, 99):
            assert got[phase][f"p{p}"] == pytest.approx(np.percentile(mine, p)), (phase, p)


def test_percentiles_without_keys_and_sketch(spark):
    df = spark.range(1001).withColumnRenamed("id", "ms")
    row = percentiles.percentile_summary(df, [], "ms").first()
    assert (row["n"], row["p50"], row["p95"]) == (1001, 500.0, 950.0)
    assert percentiles.percentile_sketch(df, [], "ms").first()["p50"] == pytest.approx(500, abs=2)


def test_profile(spark, orders):
    found = profile.build_profile(orders, "orders", with_examples=True)
    assert (found.n_rows, found.n_cols) == (6, 7)
    assert found.numeric == ["order_id", "customer_id", "revenue", "quantity"]
    assert found.temporal == ["order_date"] and "region" in found.categorical
    assert found.column("region").examples == ("North", "South", "East")
    assert len(found.sample_rows) == 5
    for distinct in ("exact",):
        rows = {r["name"]: (r["n_unique"], r["n_null"]) for r in profile.profile_frame(orders, distinct).collect()}
        assert rows["region"] == (4, 0) and rows["order_date"] == (6, 0)
    sketched = {r["name"]: r["n_unique"] for r in profile.profile_frame(orders, "approx").collect()}
    assert abs(sketched["region"] - 4) <= 1


def test_profile_counts_every_type(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (true, 1.5D, date'2024-01-01', timestamp'2024-01-01 01:00:00', timestamp_ntz'2024-01-01 01:00:00', 1.10BD, array(1), map('a', 1), repeat('x', 100)),
           (true, double('nan'), null, null, null, null, null, null, repeat('x', 100)),
           (false, -0.0D, date'2024-01-01', timestamp'2024-01-01 02:00:00', timestamp_ntz'2024-01-01 02:00:00', 1.1BD, array(1), map('a', 2), concat(repeat('x', 99), 'y')),
           (null, 0.0D, date'2024-01-02', timestamp'2024-01-01 02:00:00', timestamp_ntz'2024-01-01 02:00:00', 2.0BD, array(1, 2), map('a', 1), null)
           AS t(b, d, day, ts, ntz, dec, arr, m, s)"""
    )
    got = {r["name"]: (r["n_unique"], r["n_null"]) for r in profile.profile_frame(df).collect()}
    assert got == {
        "b": (2, 1), "d": (2, 1), "day": (2, 1), "ts": (2, 1), "ntz": (2, 1), "dec": (2, 1), "arr": (2, 1), "m": (2, 1), "s": (2, 1),
    }


def test_column_list_reads_nothing(orders):
    listed = profile.column_list(orders)
    assert [r["name"] for r in listed.collect()] == orders.columns
    assert listed.collect()[6]["dtype"] == "date"


def test_auto_profile_keeps_roles_exact(spark):
    df = spark.range(30_000).select(F.col("id"), (F.col("id") % 50).cast("string").alias("few"), (F.col("id") % 51).cast("string").alias("more"))
    found = profile.build_profile(df)
    assert found.categorical == ["few"]
    assert found.column("few").n_unique == 50 and abs(found.column("id").n_unique - 30_000) < 3_000
    assert not math.isnan(found.n_rows)


def plain_pearson(a, b):
    both = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    if len({x for x, _ in both}) < 2 or len({y for _, y in both}) < 2:
        return 0.0
    mx, my = (sum(v) / len(both) for v in zip(*both))
    xy, xx, yy = (sum(f(x - mx, y - my) for x, y in both) for f in (lambda x, y: x * y, lambda x, y: x * x, lambda x, y: y * y))
    return xy / (xx * yy) ** 0.5


@pytest.mark.parametrize("width", [1, 2, 7, 8, 9, 40])
def test_matrix_of_any_width_with_gaps(spark, width):
    random.seed(width)
    columns = [[None if random.random() < (0.3 if k % 3 else 0) else random.gauss(10.0**k if k < 9 else 0, 1) + (i if k % 2 else -i) * 0.01 for i in range(150)] for k in range(width)]
    if width > 6:
        columns[3] = [5.1 if i % 2 else None for i in range(150)]  # does not vary
        columns[4] = [float(i) if i % 2 == 0 else None for i in range(150)]  # no row with the one before
        columns[5] = [None] * 150
    frame = spark.createDataFrame(list(zip(*columns)), ", ".join(f"c{k} double" for k in range(width))).repartition(3)
    found = {(r["row"], r["col"]): r["r"] for r in stats.correlation_matrix(frame).collect()}
    assert len(found) == width * width
    for i in range(width):
        for j in range(width):
            expected = 1.0 if i == j else plain_pearson(columns[i], columns[j])
            assert found[f"c{i}", f"c{j}"] == pytest.approx(expected, abs=1e-7)

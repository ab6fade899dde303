import random

import pytest
from pyspark.sql import functions as F

from tallyward import Dataset
from tallyward.operators import containment
from tallyward.operators.joins import join_view, joined_metric
from tallyward.operators.metrics import run_metric
from tallyward.plans.catalog import JoinPolicy, MetricDefinition
from tallyward.sources.registry import DatasetRegistry
from tests.conftest import values


def policy(left_key, right_key, join_type="inner", status="approved"):
    return JoinPolicy("p", "orders", "customers", left_key, right_key, join_type, status=status)


@pytest.fixture()
def tables(spark):
    left = spark.createDataFrame([(1, 10, 5.0), (2, 20, 7.0), (3, None, 1.0)], "order_id int, customer_id int, amount double")
    right = spark.createDataFrame([(10, "North", 1.0), (30, "East", 2.0), (None, "None", 3.0)], "customer_id int, region string, amount double")
    return left, right


def test_same_key_name_and_collision(tables):
    left, right = tables
    joined = join_view(left, right, policy("customer_id", "customer_id"))
    assert joined.columns == ["order_id", "customer_id", "amount", "region", "amount_joined"]
    assert sorted(values(joined), key=str) == [(1, 10, 5.0, "North", 1.0), (3, None, 1.0, "None", 3.0)]


def test_null_keys_can_be_kept_apart(tables):
    left, right = tables
    assert join_view(left, right, policy("customer_id", "customer_id"), null_safe=False).count() == 1


def test_left_join_and_other_key_name(tables):
    left, right = tables
    other = right.withColumnRenamed("customer_id", "order_id")
    joined = join_view(left, other, policy("customer_id", "order_id", "left"))
    assert joined.columns == ["order_id", "customer_id", "amount", "order_id_joined", "region", "amount_joined"]
    assert joined.count() == 3 and joined.where("order_id_joined IS NULL AND customer_id = 20").count() == 1


def test_registry(spark, tables, orders):
    left, right = tables
    registry = DatasetRegistry()
    with pytest.raises(ValueError):
        registry.get()
    registry.add(" Sales ", Dataset("sales", orders))
    registry.add("other", Dataset("other", left))
    assert registry.get("SALES").name == "sales" and registry.get("unknown").name == "sales"
    assert registry.names() == ["other", "sales"] and "Other " in registry and len(registry) == 2
    registry.register_table("orders", left)
    registry.register_table("customers", right)
    assert registry.joined_view(policy("customer_id", "customer_id")).count() == 2
    with pytest.raises(ValueError):
        registry.joined_view(policy("customer_id", "customer_id", status="pending"))
    with pytest.raises(ValueError):
        registry.table("nope")
    with pytest.raises(ValueError):
        JoinPolicy("p", "a", "b", "k", "k", "cross")


@pytest.mark.parametrize("small", [0, 1000])
def test_containment_equals_brute_force(spark, small):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé😀 \n") for _ in range(rng.randint(1, 30)))
    texts = [(i, "".join(word() for _ in range(rng.randint(0, 12)))) for i in range(120)]
    texts += [(1000 + i, None if i == 0 else "a" * i) for i in range(40)]
    # Short and long values, pieces of the texts across word borders, and values that share their runs.
    wanted = [word() for _ in range(30)] + ["a" * n for n in (9, 20, 60)] + ["", None, "É"]
    wanted += [t[5:5 + rng.randint(1, 25)] for _, t in texts[:40] if t and len(t) > 30]
    df = spark.createDataFrame(texts, "id int, text string")
    vals = spark.createDataFrame([(v,) for v in wanted], "v string")
    got = {r["id"] for r in containment.texts_containing(df, "id", "text", vals, "v", small=small).collect()}
    needles = [v.lower() for v in wanted if v]
    assert got == {i for i, t in texts if t and any(n in t.lower() for n in needles)}
    pairs = containment.matching_pairs(df, "id", "text", containment.known_values(vals, "v"))
    expected = {(i, n) for i, t in texts if t for n in set(needles) if n in t.lower()}
    assert {tuple(r) for r in pairs.collect()} == expected


def test_containment_without_values(spark):
    df = spark.createDataFrame([(1, "abc")], "id int, text string")
    none = spark.createDataFrame([], "v string")
    assert containment.texts_containing(df, "id", "text", none, "v").count() == 0
    assert containment.texts_containing(df, "id", "text", none, "v", small=-1).count() == 0


def test_runs_without_an_anchor_are_not_shuffled(spark, monkeypatch):
    texts = spark.range(300).select("id", F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit("needle in "), F.col("id").cast("string")).alias("_text"))
    vals = containment.known_values(spark.range(0, 600, 3).select(F.concat(F.lit("needle in "), F.col("id").cast("string")).alias("v")), "v")
    anchors = containment._anchors(vals)
    every = texts.agg(F.sum(F.length("_text") - containment.RUN + 1)).first()[0]
    wanted = values(texts.join(vals, F.col("_text").contains(F.col("value"))).select("id", "value"))
    assert containment.mapped_runs(texts, "id", anchors).count() < every / 40
    assert sorted(values(containment.matching_pairs(texts, "id", "_text", vals))) == sorted(wanted)
    monkeypatch.setattr(containment, "MAP_WORDS", 1)  # a full map
    assert containment.mapped_runs(texts, "id", anchors).count() > every / 2
    assert sorted(values(containment.matching_pairs(texts, "id", "_text", vals))) == sorted(wanted)


def test_hot_key_join_keeps_every_row(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = join_view(left, right, policy("k", "k"))
    assert joined.count() == sum(1 for i in range(3000) if (7 if i % 3 == 0 else i) < 50)


@pytest.mark.parametrize("join_type", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_metrics_below_the_join(spark, join_type, null_safe):
    random.seed(f"{join_type}{null_safe}")
    some = lambda *options: random.choice([None, *options])
    left = spark.createDataFrame([(some(1, 2, 3, 4), some("a", "b"), some(1.5, -2.0, 8.0), i) for i in range(60)], "k int, g string, x double, n long").repartition(3)
    right = spark.createDataFrame([(some(1, 2, 3, 9), some("p", "q"), some(0.5, 7.0), some("a", "c")) for _ in range(40)], "k int, h string, y double, g string").repartition(2)
    columns = {"sum": "x", "mean": "y", "max": "y", "min": "n", "count": "x", "nunique": "y"}
    wanted = [(names, agg, group) for names in ("k", "key") for agg in columns for group in (None, "g", "h", "g_joined", "k")]
    for name, agg, group in random.sample(wanted, 12):
        other, how = right.withColumnRenamed("k", name), policy("k", name, join_type)
        filters = random.choice([None, {"g": "a"}, {"h": "p"}, {"g": "b", "g_joined": "c"}])
        metric = MetricDefinition("m", columns[agg], agg, group)
        plain = run_metric(join_view(left, other, how, null_safe), metric, filters)
        found = joined_metric(left, other, how, metric, filters, null_safe)
        assert found.schema.simpleString() == plain.schema.simpleString(), metric
        got, expected = ({r.asDict().get("key"): r["value"] for r in f.collect()} for f in (found, plain))
        assert got == pytest.approx(expected), (name, metric, filters)


def test_null_keys_are_no_product(spark):
    """A million joined rows of null keys, from a thousand on each side, are one pair of rows."""
    left = spark.range(1000).select(F.lit(None).cast("int").alias("k"), F.lit(2.0).alias("x"))
    right = spark.range(1000).select(F.lit(None).cast("int").alias("k"), F.lit("a").alias("g"))
    assert values(joined_metric(left, right, policy("k", "k"), MetricDefinition("m", "x", "sum", "g"))) == [("a", 2_000_000.0)]
    with pytest.raises(ValueError):
        joined_metric(left, right, policy("k", "k"), MetricDefinition("m", "nope", "sum", "g"))

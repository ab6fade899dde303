import random
import re

import pytest
from pyspark.sql import functions as F

from tallyward.operators import matching, profile, question_index
from tallyward.plans.catalog import MetricDefinition, generate_metrics

QUESTIONS = {
    # question: (plan type, target)
    "What is the total revenue?": ("single_metric", "total_revenue"),
    "What are our total sales?": ("single_metric", "total_revenue"),
    "Show me revenue by region": ("stats_tool", "group_compare"),
    "break down revenue by regions": ("stats_tool", "group_compare"),
    "Revenue per region": ("single_metric", "revenue_by_region"),
    "What is the average revenue?": ("single_metric", "avg_revenue"),
    "Describe the data": ("stats_tool", "describe"),
    "How many rows are there": ("stats_tool", "describe"),
    "Are there any outliers in revenue?": ("stats_tool", "anomaly_detect"),
    "unusual revenue values": ("stats_tool", "anomaly_detect"),
    "give me strategic recommendations": ("stats_tool", "describe"),
    "highest quantity for me": ("single_metric", "max_quantity"),
    "Tell me a joke": ("no_match", None),
    "Who won the cup?": ("no_match", None),
    "": ("no_match", None),
    None: ("no_match", None),
}


@pytest.fixture(scope="module")
def resolved(spark, orders):
    found = profile.build_profile(orders, with_examples=True)
    frame = spark.createDataFrame([(q,) for q in QUESTIONS], "q string")
    return {r["q"]: r for r in matching.resolve_questions(frame, "q", found, generate_metrics(found)).collect()}


@pytest.mark.parametrize("question", QUESTIONS)
def test_resolution(resolved, question):
    row = resolved[question]
    assert (row["plan_type"], row["target"]) == QUESTIONS[question]


def test_arguments(resolved):
    row = resolved["Show me revenue by region"]
    assert (row["value_col"], row["group_col"], row["agg"], row["route"]) == ("revenue", "region", "sum", "breakdown")
    unusual, overview = resolved["unusual revenue values"], resolved["give me strategic recommendations"]
    assert (unusual["value_col"], unusual["threshold"], unusual["columns"]) == ("revenue", 1.5, None)
    assert (overview["threshold"], overview["columns"]) == (None, ["order_id", "customer_id", "revenue", "quantity"])


def test_catalog_of_many_phrases(spark):
    many = [MetricDefinition(f"metric_{i:05d}", "x", "sum", None, (f"word{i:05d} a", f"word{i:05d} b")) for i in range(8000)]
    frame = spark.createDataFrame([("show WORD07999 b please",), ("nothing",)], "q string")
    assert [r[0] for r in frame.select(matching.match_synonym(F.col("q"), many)).collect()] == ["metric_07999", None]


def test_product_guard_falls_through_to_matching(spark, orders):
    found = profile.build_profile(orders)
    frame = spark.createDataFrame([("how are products doing",), ("total revenue of products",)], "q string")
    got = [r["plan_type"] for r in matching.resolve_questions(frame, "q", found, generate_metrics(found)).collect()]
    assert got == ["no_match", "single_metric"]


def test_sum_metric_choice(spark):
    make = lambda column, *synonyms: MetricDefinition(f"total_{column}", column, "sum", None, synonyms)
    metrics = [make("quantity"), make("sales", "total sales"), make("price"), make("order_id", "total sales"), MetricDefinition("avg_sales", "sales", "mean")]
    pick = lambda q, ms: spark.range(1).select(matching.pick_sum_metric(F.lit(q), ms)).first()[0]
    assert pick("total sales", metrics) == "total_sales" and pick("total of all", metrics) == "total_sales"
    assert pick("total sales", [make("quantity")]) is None and pick("total", [make("quantity"), make("weight")]) == "total_weight"
    assert pick("total", []) is None


def naive_column(question, columns, examples):
    """The rules once more, word by word."""
    spoken = question.lower().split()
    for column in columns:
        low = column.lower()
        parts = low.split("_")
        for w in spoken:
            s = w.rstrip("s")
            if w == low or s == low.rstrip("s") or w in parts or s in [p.rstrip("s") for p in parts]:
                return column
            if len(w) >= 3 and (w in low or low in w or s in low.rstrip("s")):
                return column
        if any(w in examples.get(column, ()) or w.rstrip("s") in examples.get(column, ()) for w in spoken):
            return column
    return None


def test_columns_equal_the_plain_rules(spark):
    columns = ["order_id", "Unit_Prices", "region", "status", "s"]
    examples = {"region": ["north", "south"], "status": ["open"]}
    texts = re.findall(r"[^;]+", "orders;unit price;prices please;the regions;norths of it;sss;open;opens now;reg;id;xx yy;subregions;statu;an ord;  ;STATUSES")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(matching.match_column(F.col("t"), columns, examples)).collect()]
    assert got == [naive_column(t, columns, examples) for t in texts]


def test_coverage(spark, orders):
    found = profile.build_profile(orders)
    rows = [("total revenue", "single_metric"), ("tell a joke", "no_match"), ("tell a joke", "single_metric")]
    frame = matching.resolve_questions(spark.createDataFrame(rows, "q string, expected string"), "q", found, generate_metrics(found))
    got = {r["expected"]: (r["n"], r["answered_as_expected"], r["share"]) for r in matching.coverage(frame, "expected").collect()}
    assert got == {"single_metric": (2, 1, 0.5), "no_match": (1, 1, 1.0)}


def test_index_equals_the_plain_rules(spark, orders):
    """Questions of random words and pieces of names about two catalogs, and one that has no catalog."""
    random.seed(4)
    first = profile.build_profile(orders, with_examples=True)
    second = profile.build_profile(orders.select(F.col("revenue").alias("Net_Prices"), F.col("region").alias("s"), F.col("category").alias("cat_s")), with_examples=True)
    odd = [MetricDefinition(f"m{i}", "x", "sum", None, (p,)) for i, p in enumerate(("q", "né", "price of all things", "zz zz", "the price of", "t"))]
    metrics = {"a": generate_metrics(first), "b": {m.name: m for m in (*generate_metrics(second).values(), *odd)}}
    catalogs = {"a": question_index.Catalog(first, metrics["a"]), "b": question_index.Catalog(second, metrics["b"])}
    names = [*first.numeric, *first.categorical, *second.numeric, *second.categorical, "north", "Souths", "A", "bs", "sss", "s", "né", "q"]
    spoken = [*names, *[n[1:] for n in names], *[n[:4] for n in names], *[f"x{n}y" for n in names], "by", "total", "average", "per", "price", "of all things", "zz"]
    texts = [" ".join(random.choices(spoken, k=random.randrange(7))) for _ in range(300)] + [None, "", "  ", *(p for m in odd for p in m.synonyms)]
    for phrases in (p for ms in metrics.values() for m in ms.values() for p in m.synonyms):
        texts.append(random.choice(["x", " ", ""]) + phrases.upper() + random.choice(["y", " z"]))
    rows = [(i, d, t) for i, t in enumerate(texts) for d in ("a", "b", "c", None)] * 2
    asked = spark.createDataFrame(rows, "i int, d string, t string")
    found = question_index.match_questions(asked, "t", catalogs, F.col("d"))
    got = {(r["i"], r["d"]): (r["number"], r["category"], r["synonym"]) for r in found.collect()}
    assert found.count() == len(rows) and {v for (_, d), v in got.items() if d not in ("a", "b")} == {(None, None, None)}
    for name, catalog in catalogs.items():
        own = asked.where(F.col("d") == name).distinct()
        examples = {c.name: c.examples for c in catalog.profile.columns if c.is_categorical}
        plain = own.select("i", matching.match_column(F.col("t"), catalog.profile.numeric), matching.match_column(F.col("t"), catalog.profile.categorical, examples), matching.match_synonym(F.col("t"), list(catalog.metrics.values())))
        assert {r[0]: tuple(r)[1:] for r in plain.collect()} == {i: v for (i, d), v in got.items() if d == name}
    resolved = question_index.resolve(asked, "t", catalogs, F.col("d"))
    assert resolved.count() == len(rows) and resolved.where("d IS NULL OR d = 'c'").select("route").distinct().collect() == [("none",)]


def test_phrases_are_looked_up(spark):
    many = {f"metric_{i:05d}": MetricDefinition(f"metric_{i:05d}", "x", "sum", None, (f"total word{i:05d} a",)) for i in range(3000)}
    catalog = question_index.Catalog(profile.build_profile(spark.range(3)), many)
    found = question_index.match_questions(spark.createDataFrame([("show TOTAL WORD02999 A please",), ("total word",)], "q string"), "q", {"": catalog})
    assert [r["synonym"] for r in found.orderBy("q").collect()] == ["metric_02999", None]
    assert "word02999" not in found._jdf.queryExecution().executedPlan().toString()

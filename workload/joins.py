"""Governed joins, value containment and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators import containment, joins
from tallyward.plans.catalog import JoinPolicy, MetricDefinition
from workload.inputs import table


def _policy(left_key: str, right_key: str, join_type: str = "inner") -> JoinPolicy:
    return JoinPolicy("policy", "left", "right", left_key, right_key, join_type, status="approved")


def _orders_customers(spark: SparkSession, sf_dir: str, join_type: str = "inner") -> DataFrame:
    return joins.join_view(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), _policy("o_custkey", "c_custkey", join_type))


def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 2000")
    joined = joins.join_view(table(spark, sf_dir, "orders"), poor, _policy("o_custkey", "c_custkey", "left"))
    return joined.select("o_orderkey", "o_custkey", "c_custkey", "c_mktsegment")


def _collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("quality"))
    return joins.join_view(docs, table(spark, sf_dir, "labels"), _policy("doc_id", "doc_id", "left"))


def _null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").groupBy(F.nullif("event_type", F.lit("error")).alias("kind")).agg(F.count("*").alias("n"))
    events = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return joins.join_view(events, kinds, _policy("kind", "kind"))


def _joined(spark: SparkSession, sf_dir: str, metric: MetricDefinition) -> DataFrame:
    return joins.joined_metric(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), _policy("o_custkey", "c_custkey"), metric)


def _metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, MetricDefinition("m", "o_totalprice", "sum", "c_mktsegment")).withColumn("value", F.round("value", 2))


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, MetricDefinition("m", "o_totalprice", "mean", "c_nationkey")).withColumn("value", F.round("value", 4))


def _known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents")
    return containment.texts_containing(texts, "doc_id", "text", table(spark, sf_dir, "benchmark"), "text").select("doc_id", "source")


def _known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold the first word of a part's name."""
    texts = table(spark, sf_dir, "pages")
    names = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("word"))
    return containment.texts_containing(texts, "page_id", "html", names, "word").select("page_id", "url")


def _known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names of parts each part's description holds: more names than a short list."""
    parts = table(spark, sf_dir, "part")
    texts = parts.select("p_partkey", F.concat_ws(" ", "p_type", F.upper("p_name"), "p_brand").alias("text"))
    pairs = containment.matching_pairs(texts, "p_partkey", "text", containment.known_values(parts, "p_name"))
    return pairs.groupBy("p_partkey").agg(F.count("*").alias("names"))


QUERIES = {
    "join_inner": lambda s, d: _orders_customers(s, d).select("o_orderkey", "o_custkey", "c_custkey", "c_mktsegment", "c_acctbal"),
    "join_left": _left,
    "join_collision": _collision,
    "join_null_keys": _null_keys,
    "join_metric": _metric,
    "join_group_compare": _compare,
    "leak_known_values": _known_values,
    "leak_known_words": _known_words,
    "leak_known_names": _known_names,
}

ORACLES = {
    "join_inner": "SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": """SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment FROM orders
        LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 2000) ON o_custkey = c_custkey""",
    "join_collision": """SELECT d.doc_id, d.lang, d.n_chars AS quality, l.quality AS quality_joined, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "join_null_keys": """WITH e AS (SELECT event_id, nullif(event_type, 'error') AS kind FROM events),
        k AS (SELECT kind, count(*) AS n FROM e GROUP BY 1)
        SELECT e.event_id, e.kind, k.n FROM e JOIN k ON e.kind IS NOT DISTINCT FROM k.kind""",
    "join_metric": """SELECT c_mktsegment AS key, round(sum(o_totalprice), 2) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "join_group_compare": """SELECT c_nationkey AS key, round(avg(o_totalprice), 4) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "leak_known_values": """SELECT doc_id, source FROM documents d
        WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(d.text), lower(b.text)))""",
    "leak_known_names": """WITH w AS (SELECT DISTINCT lower(p_name) AS name FROM part),
        t AS (SELECT p_partkey, lower(concat_ws(' ', p_type, upper(p_name), p_brand)) AS text FROM part)
        SELECT p_partkey, count(*) AS names FROM t JOIN w ON contains(text, name) GROUP BY p_partkey""",
    "leak_known_words": """WITH w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS word FROM part)
        SELECT page_id, url FROM pages WHERE EXISTS (SELECT 1 FROM w WHERE contains(lower(html), word))""",
}

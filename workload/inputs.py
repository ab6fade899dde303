"""Inputs of the queries: the given tables, and views over them in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# Events as an audit log: one tenant per user, one user name per value of k in the properties.
AUDIT = """
SELECT event_id AS id, ts AS timestamp, concat('user-', substring(props, 7, length(props) - 7)) AS username,
       CASE WHEN value > 50 THEN 'admin' ELSE 'analyst' END AS role,
       CASE event_type WHEN 'view' THEN 'QUERY' WHEN 'click' THEN 'METRIC_RESOLVE' WHEN 'signup' THEN 'LOGIN'
            WHEN 'error' THEN 'ERROR' ELSE 'METRIC_PROPOSE' END AS action_type,
       props AS details, '127.0.0.1' AS ip_address, concat('tenant-', user_id) AS tenant_id
FROM {events}
"""

# Events as telemetry with the kinds the usage counters know.
USAGE = """
SELECT event_id AS id, ts AS timestamp, concat('tenant-', user_id) AS tenant_id,
       CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'query' WHEN 'purchase' THEN 'llm_call'
            WHEN 'signup' THEN 'upload' ELSE 'error' END AS event_type,
       CAST(substring(props, 7, length(props) - 7) AS BIGINT) AS rows_scanned
FROM {events}
"""

# Tenants with a daily limit of their own: those with an event of a high value.
LIMITS = """
SELECT concat('tenant-', user_id) AS tenant_id, CAST(floor(min(event_id) / 1000.0) AS BIGINT) AS daily_limit
FROM {events} WHERE value > 90 GROUP BY user_id
"""

# Events as runs of plans, and limits of some tenants, not all of them for both.
LIMITED_RUNS = """
SELECT event_id AS id, concat('tenant-', user_id) AS tenant_id, CAST(substring(props, 7, length(props) - 7) AS BIGINT) * 5000 AS rows,
       value AS seconds, CAST(event_id % 6 AS INT) AS plan_steps
FROM {events}
"""
TENANT_LIMITS = """
SELECT concat('tenant-', user_id) AS tenant_id, CAST(min(event_id) AS BIGINT) * 10 AS max_rows_per_query,
       CASE WHEN count(*) > 3 THEN 60 END AS query_timeout_seconds
FROM {events} WHERE value > 40 GROUP BY user_id
"""

# A question per event.
QUESTIONS = """
SELECT event_id AS question_id, user_id,
       CASE event_type
            WHEN 'view' THEN concat('  Show me Value by event_type for user ', user_id, '?')
            WHEN 'click' THEN concat('What is the average  value per event type in case ', event_id, '?!')
            WHEN 'purchase' THEN concat('How much value came from tenant ', user_id, '...')
            WHEN 'error' THEN concat('Are there any outliers in row ', event_id)
            ELSE concat('How many rows has product ', user_id, ' ?') END AS question,
       CASE event_type WHEN 'view' THEN 'stats_tool' WHEN 'click' THEN 'single_metric' WHEN 'purchase' THEN 'single_metric'
            WHEN 'error' THEN 'stats_tool' ELSE 'no_match' END AS expected
FROM {events}
"""

# A question per event about one of two datasets, of every kind that the rules tell apart.
QUESTION_LOG = """
SELECT event_id AS question_id, CASE WHEN user_id % 2 = 0 THEN 'events' ELSE 'orders' END AS dataset,
       CASE event_id % 20
            WHEN 0 THEN concat('Describe the data for ', event_type)
            WHEN 1 THEN concat('How many records of ', event_type, '?')
            WHEN 2 THEN concat(' Any anomaly in ', event_type, ' events')
            WHEN 3 THEN concat('Total revenue of user ', user_id)
            WHEN 4 THEN concat('overall amount by event_type, ', event_type)
            WHEN 5 THEN concat('Show me VALUES by event_types for user ', user_id)
            WHEN 6 THEN concat('unusual totalprice or values of ', user_id)
            WHEN 7 THEN concat('give me strategic insights on ', event_type)
            WHEN 8 THEN concat('average value per event_type in case ', event_id)
            WHEN 9 THEN concat('avg  totalprice for each o_orderpriority, user ', user_id)
            WHEN 10 THEN concat('compare user_ids versus event types or orderstatus of ', event_type)
            WHEN 11 THEN concat('mean o_custkey please, user ', user_id)
            WHEN 12 THEN concat('what distribution of event_type and distribution of o_orderstatus has ', event_type)
            WHEN 13 THEN concat('highest o totalprice or highest value ever, ', user_id)
            WHEN 14 THEN concat('how are products doing with total value, ', event_type)
            WHEN 15 THEN ''
            WHEN 17 THEN concat('Tell me a joke, ', event_type)
            WHEN 18 THEN concat('Sum of sales in the top ', user_id)
            WHEN 19 THEN concat('what is the typical value or o totalprice average in ', event_id) END AS question
FROM {events}
"""

# Customers in the shape the masking knows, with their nation as the city.
CUSTOMERS = """
SELECT c_custkey AS customer_id, 'Customer' AS first_name, substring(c_name, 10) AS last_name,
       concat(lower(c_mktsegment), '.', c_custkey, '@shop.example.com') AS email,
       concat('+1-555-', substring(c_name, 12)) AS phone, concat(c_custkey, ' ', c_mktsegment, ' Street') AS address,
       r_name AS region, n_name AS city
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the given tables."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in sql}
    return spark.sql(sql, **used)


def oracle(sql: str, **views: str) -> str:
    """Oracle SQL with views as common table expressions; in the views a table is named by itself."""
    named = ", ".join(f"{name} AS ({plain(text)})" for name, text in views.items())
    return f"WITH {named} {sql}" if named else sql


def plain(sql: str) -> str:
    """A view's SQL with table names in place of the braces."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql.strip()

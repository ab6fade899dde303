"""Matching a log of questions against the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators import matching, profile, question_index
from tallyward.plans.catalog import generate_metrics
from workload.inputs import QUESTION_LOG, QUESTIONS, oracle, table, view


def _catalog(spark: SparkSession, sf_dir: str, name: str = "events"):
    found = profile.build_profile(table(spark, sf_dir, name), name)
    return found, generate_metrics(found)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogs = {name: question_index.Catalog(*_catalog(spark, sf_dir, name)) for name in ("events", "orders")}
    return question_index.resolve(view(spark, sf_dir, QUESTION_LOG), "question", catalogs, F.col("dataset"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = question_index.Catalog(*_catalog(spark, sf_dir), examples=False)
    return question_index.match_questions(view(spark, sf_dir, QUESTIONS), "question", {"": found})


def _intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, metrics = _catalog(spark, sf_dir)
    rule = matching.intent(F.col("question"), found, list(metrics.values()))
    return view(spark, sf_dir, QUESTIONS).withColumn("r", rule).select("question_id", "r.plan_type", "r.target", "r.group_col", "r.route")


def _pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics = _catalog(spark, sf_dir)
    pick = matching.pick_sum_metric(F.col("question"), list(metrics.values()))
    return view(spark, sf_dir, QUESTIONS).select("question_id", pick.alias("metric"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, metrics = _catalog(spark, sf_dir)
    return matching.resolve_questions(view(spark, sf_dir, QUESTIONS), "question", found, metrics)


QUERIES = {
    "match_synonyms": lambda s, d: _matched(s, d).select("question_id", F.col("synonym").alias("metric")),
    "match_intent": _intent,
    "pick_sum_metric": _pick,
    "match_columns": lambda s, d: _matched(s, d).select("question_id", "number", "category"),
    "resolve_questions": lambda s, d: _resolved(s, d).select("question_id", "plan_type", "target", "value_col", "group_col", "agg", "route"),
    "route_questions": lambda s, d: _routed(s, d).select("question_id", "plan_type", "target", "value_col", "group_col", "agg", "route"),
    "match_coverage": lambda s, d: matching.coverage(_resolved(s, d), "expected"),
}

# Catalog of the events table in order, as far as the questions can meet it: (order, metric, phrase).
PHRASES = """
SELECT * FROM (VALUES
  (1, 'total_value', 'total value'), (1, 'total_value', 'value total'), (1, 'total_value', 'sum of value'), (1, 'total_value', 'how much value'),
  (1, 'total_value', 'overall value'), (1, 'total_value', 'sum value'), (1, 'total_value', 'total_value'),
  (2, 'avg_value', 'avg value'), (2, 'avg_value', 'average value'), (2, 'avg_value', 'mean value'), (2, 'avg_value', 'typical value'), (2, 'avg_value', 'value average'),
  (3, 'max_value', 'max value'), (3, 'max_value', 'highest value'), (3, 'max_value', 'maximum value'),
  (4, 'min_value', 'min value'), (4, 'min_value', 'lowest value'), (4, 'min_value', 'minimum value'),
  (5, 'row_count', 'row count'), (5, 'row_count', 'how many rows'), (5, 'row_count', 'number of rows'), (5, 'row_count', 'how many records'),
  (5, 'row_count', 'dataset size'), (5, 'row_count', 'total rows'),
  (8, 'event_id_by_event_type', 'event_id by event_type'), (9, 'avg_event_id_by_event_type', 'avg event_id per event_type'),
  (10, 'user_id_by_event_type', 'user_id by event_type'), (12, 'value_by_event_type', 'value by event type'),
  (12, 'value_by_event_type', 'value by event_type'), (12, 'value_by_event_type', 'value per event_type'),
  (13, 'avg_value_by_event_type', 'avg value by event type')
) AS p(ord, metric, phrase)
"""

# The columns of both datasets, their metrics in order, and all phrases of a metric by its kind.
COLUMNS = """
SELECT * FROM (VALUES ('events', 'number', 0, 'event_id'), ('events', 'number', 1, 'user_id'), ('events', 'number', 2, 'value'),
  ('events', 'category', 0, 'event_type'), ('orders', 'number', 0, 'o_orderkey'), ('orders', 'number', 1, 'o_custkey'),
  ('orders', 'number', 2, 'o_totalprice'), ('orders', 'category', 0, 'o_orderstatus'), ('orders', 'category', 1, 'o_orderpriority')
) AS c(dataset, kind, pos, name)
"""
METRICS = """
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY part, pos, dim_pos, agg_pos) AS ord, agg, num, dim,
       CASE WHEN agg = 'rows' THEN 'row_count' WHEN agg = 'count' THEN concat('count_by_', dim) WHEN agg = 'unique' THEN concat('unique_', num)
            ELSE concat(CASE WHEN agg = 'sum' AND dim IS NULL THEN 'total_' WHEN agg = 'mean' THEN 'avg_' WHEN agg IN ('max', 'min') THEN concat(agg, '_') ELSE '' END,
                        num, CASE WHEN dim IS NULL THEN '' ELSE concat('_by_', dim) END) END AS metric
FROM (
  SELECT dataset, 1 AS part, pos, 0 AS dim_pos, agg_pos, agg, name AS num, NULL AS dim
  FROM c, (VALUES (1, 'sum'), (2, 'mean'), (3, 'max'), (4, 'min')) AS a(agg_pos, agg) WHERE kind = 'number' AND NOT ends_with(name, '_id')
  UNION ALL SELECT DISTINCT dataset, 2, 0, 0, 0, 'rows', NULL, NULL FROM c
  UNION ALL SELECT dataset, 3, pos, 0, 0, 'unique', name, NULL FROM c WHERE kind = 'number' AND ends_with(name, '_id')
  UNION ALL SELECT n.dataset, 4, n.pos, d.pos, agg_pos, agg, n.name, d.name
  FROM c AS n JOIN c AS d ON n.dataset = d.dataset AND n.kind = 'number' AND d.kind = 'category', (VALUES (1, 'sum'), (2, 'mean')) AS a(agg_pos, agg)
  UNION ALL SELECT dataset, 5, 0, pos, 0, 'count', NULL, name FROM c WHERE kind = 'category')
"""
ALL_PHRASES = """
SELECT dataset, ord, metric, unnest(list_append(CASE
  WHEN agg = 'rows' THEN ['how many rows', 'number of rows', 'how many records', 'dataset size', 'total rows']
  WHEN agg = 'unique' THEN ['number of ' || s, 'count of ' || s, 'how many ' || s, 'distinct ' || num]
  WHEN agg = 'count' THEN ['count by ' || dim, 'number of items per ' || dim, 'distribution of ' || dim]
  WHEN agg = 'sum' AND dim IS NULL THEN [metric, s || ' total', 'sum of ' || s, 'how much ' || s, 'overall ' || s, 'sum ' || s]
  WHEN agg = 'mean' AND dim IS NULL THEN ['average ' || s, 'mean ' || s, 'typical ' || s, s || ' average']
  WHEN agg = 'max' THEN ['highest ' || s, 'maximum ' || s] WHEN agg = 'min' THEN ['lowest ' || s, 'minimum ' || s]
  WHEN agg = 'sum' THEN [num || ' by ' || dim, num || ' per ' || dim, 'breakdown of ' || num || ' by ' || dim, 'total ' || num || ' by ' || dim]
  ELSE ['average ' || num || ' by ' || dim, 'avg ' || num || ' per ' || dim, 'mean ' || num || ' by ' || dim] END, replace(metric, '_', ' '))) AS phrase
FROM (SELECT *, replace(num, '_', ' ') AS s FROM m)
"""
ROUTES = r"""
SELECT question_id, coalesce(r.plan, f.plan, CASE WHEN product THEN 'no_match' END, 'no_match') AS plan_type, coalesce(r.target, f.target) AS target,
       CASE WHEN r.plan IS NOT NULL THEN r.value_col ELSE f.value_col END AS value_col, CASE WHEN r.plan IS NOT NULL THEN r.group_col ELSE f.group_col END AS group_col,
       CASE WHEN r.plan IS NOT NULL THEN r.agg ELSE f.agg END AS agg, coalesce(r.route, f.route, CASE WHEN product THEN 'product' ELSE 'none' END) AS route
FROM (
  SELECT question_id, product,
         CASE WHEN t = '' OR product THEN {plan: NULL, target: NULL, value_col: NULL, group_col: NULL, agg: NULL, route: NULL}
              WHEN regexp_matches(t, '\b(describe|profile|summary of the data|what columns|schema)\b')
                THEN {plan: 'stats_tool', target: 'describe', value_col: NULL, group_col: NULL, agg: NULL, route: 'describe'}
              WHEN regexp_matches(t, '\b(how many rows|row count|number of rows|number of records|how many records)\b')
                THEN {plan: 'stats_tool', target: 'describe', value_col: NULL, group_col: NULL, agg: NULL, route: 'row_count'}
              WHEN regexp_matches(t, '\b(outlier|outliers|anomal|anomaly)\b')
                THEN {plan: 'stats_tool', target: 'anomaly_detect', value_col: NULL, group_col: NULL, agg: NULL, route: 'outliers'}
              WHEN regexp_matches(t, '\b(total|sum|overall)\b') AND regexp_matches(t, '\b(revenue|sales|amount)\b') AND dataset = 'orders'
                   AND NOT regexp_matches(t, '\b(highest|lowest|top|best|max|min)\b')
                THEN {plan: 'single_metric', target: 'total_o_totalprice', value_col: NULL, group_col: NULL, agg: NULL, route: 'total'}
              WHEN grouped IS NOT NULL
                THEN {plan: 'stats_tool', target: 'group_compare', value_col: CASE dataset WHEN 'events' THEN 'value' ELSE 'o_orderkey' END, group_col: grouped, agg: 'sum', route: 'breakdown'}
         END AS r,
         CASE WHEN unusual AND number IS NOT NULL THEN {plan: 'stats_tool', target: 'anomaly_detect', value_col: number, group_col: NULL, agg: NULL, route: 'outliers'}
              WHEN overview THEN {plan: 'stats_tool', target: 'describe', value_col: NULL, group_col: NULL, agg: NULL, route: 'overview'}
              WHEN groups AND number IS NOT NULL AND category IS NOT NULL AND pair IN (SELECT metric FROM m WHERE m.dataset = x.dataset)
                THEN {plan: 'single_metric', target: pair, value_col: NULL, group_col: NULL, agg: NULL, route: 'grouped'}
              WHEN groups AND number IS NOT NULL AND category IS NOT NULL
                THEN {plan: 'stats_tool', target: 'group_compare', value_col: number, group_col: category, agg: CASE WHEN average THEN 'mean' ELSE 'sum' END, route: 'grouped'}
              WHEN average AND concat('avg_', number) IN (SELECT metric FROM m WHERE m.dataset = x.dataset)
                THEN {plan: 'single_metric', target: concat('avg_', number), value_col: NULL, group_col: NULL, agg: NULL, route: 'average'}
              WHEN synonym IS NOT NULL THEN {plan: 'single_metric', target: synonym, value_col: NULL, group_col: NULL, agg: NULL, route: 'synonym'} END AS f
  FROM (
    SELECT *, concat(CASE WHEN average THEN 'avg_' ELSE '' END, number, '_by_', category) AS pair FROM (
      SELECT question_id, dataset, t, regexp_matches(t, '\bproducts?\b') AS product, regexp_matches(t, 'average|avg|mean') AS average,
             regexp_matches(t, 'outlier|outliers|anomaly|anomalies|extreme|unusual') AS unusual,
             regexp_matches(t, 'takeaway|strategic|recommendation|management|action|summary|insights|overview') AS overview,
             regexp_matches(t, 'by|per|each|highest|lowest|top|best|breakdown|compare|vs|versus|between|difference') AS groups,
             (SELECT arg_min(name, pos) FROM hit WHERE hit.t = w.t AND hit.dataset = w.dataset AND kind = 'number') AS number,
             (SELECT arg_min(name, pos) FROM hit WHERE hit.t = w.t AND hit.dataset = w.dataset AND kind = 'category') AS category,
             (SELECT arg_min(metric, ord) FROM p WHERE p.dataset = w.dataset AND contains(w.t, phrase)) AS synonym,
             (SELECT arg_min(name, CASE WHEN name = spoken THEN 0 ELSE 1 END) FROM c
              WHERE c.dataset = w.dataset AND kind = 'category' AND name IN (spoken, rtrim(spoken, 's'))) AS grouped
      FROM (SELECT question_id, dataset, lower(coalesce(question, '')) AS t, regexp_extract_all(lower(coalesce(question, '')), '\bby\s+(\w+)\b', 1)[-1] AS spoken FROM q) AS w)) AS x)
"""
HITS = r"""
SELECT DISTINCT t, w.dataset, kind, pos, name
FROM (SELECT DISTINCT lower(question) AS t, dataset, unnest(string_split_regex(lower(question), '\s+')) AS word FROM q) AS w JOIN c ON c.dataset = w.dataset
WHERE word <> '' AND (word = name OR rtrim(word, 's') = rtrim(name, 's') OR list_contains(string_split(name, '_'), word)
  OR list_contains(list_transform(string_split(name, '_'), lambda part: rtrim(part, 's')), rtrim(word, 's'))
  OR (length(word) >= 3 AND (contains(name, word) OR contains(word, name) OR contains(rtrim(name, 's'), rtrim(word, 's')))))
"""

ORACLES = {
    "route_questions": oracle(ROUTES, q=QUESTION_LOG, c=COLUMNS, m=METRICS, p=ALL_PHRASES, hit=HITS),
    "match_synonyms": oracle(
        """SELECT question_id, (SELECT arg_min(metric, ord) FROM p WHERE contains(lower(question), phrase)) AS metric FROM q""",
        q=QUESTIONS, p=PHRASES,
    ),
    "match_intent": oracle(
        r"""SELECT question_id,
            CASE WHEN product THEN 'no_match' WHEN outlier OR grouped THEN 'stats_tool' END AS plan_type,
            CASE WHEN product THEN NULL WHEN outlier THEN 'anomaly_detect' WHEN grouped THEN 'group_compare' END AS target,
            CASE WHEN NOT product AND NOT outlier AND grouped THEN 'event_type' END AS group_col,
            CASE WHEN product THEN 'product' WHEN outlier THEN 'outliers' WHEN grouped THEN 'breakdown' END AS route
            FROM (SELECT question_id, regexp_matches(lower(question), '\bproducts?\b') AS product,
                  regexp_matches(lower(question), '\b(outlier|outliers|anomal|anomaly)\b') AS outlier,
                  regexp_matches(lower(question), '\bby\s+event_types?\b') AS grouped FROM q)""",
        q=QUESTIONS,
    ),
    "match_columns": oracle(
        """SELECT question_id, CASE event_type WHEN 'view' THEN 'user_id' WHEN 'click' THEN 'event_id' WHEN 'purchase' THEN 'value' END AS number,
           CASE WHEN event_type IN ('view', 'click') THEN 'event_type' END AS category FROM q JOIN events ON event_id = question_id""",
        q=QUESTIONS,
    ),
    "resolve_questions": oracle(
        """SELECT question_id, CASE WHEN event_type IN ('view', 'error') THEN 'stats_tool' ELSE 'single_metric' END AS plan_type,
           CASE event_type WHEN 'view' THEN 'group_compare' WHEN 'click' THEN 'avg_event_id_by_event_type' WHEN 'purchase' THEN 'total_value'
                WHEN 'error' THEN 'anomaly_detect' ELSE 'row_count' END AS target,
           CASE WHEN event_type = 'view' THEN 'value' END AS value_col, CASE WHEN event_type = 'view' THEN 'event_type' END AS group_col,
           CASE WHEN event_type = 'view' THEN 'sum' END AS agg,
           CASE event_type WHEN 'view' THEN 'breakdown' WHEN 'click' THEN 'grouped' WHEN 'error' THEN 'outliers' ELSE 'synonym' END AS route
           FROM q JOIN events ON event_id = question_id""",
        q=QUESTIONS,
    ),
    "match_coverage": oracle(
        """SELECT expected, count(*) AS n, count(*) FILTER (expected <> 'no_match') AS answered_as_expected,
           round(count(*) FILTER (expected <> 'no_match') / count(*), 4) AS share FROM q GROUP BY 1""",
        q=QUESTIONS,
    ),
    "pick_sum_metric": oracle(
        r"""SELECT question_id, CASE WHEN regexp_matches(lower(question), '\b(revenue|sales|amount|price)\b') THEN NULL
            ELSE 'value_by_event_type' END AS metric FROM q""",
        q=QUESTIONS,
    ),
}

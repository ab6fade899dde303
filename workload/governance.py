"""Audit, usage and quota roll-ups, steps and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.frames import small_frame
from tallyward.operators import audit, evaluation, guards, limits, usage
from tallyward.plans import catalog, steps
from tallyward.operators.stats import TOOLS
from workload.inputs import AUDIT, LIMITED_RUNS, LIMITS, TENANT_LIMITS, USAGE, oracle, view
from workload.profiling import generated

NOW = "2024-01-20 12:00:00"
DAILY_LIMIT = 2


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, AUDIT)


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, USAGE)


RAW_DETAILS = """
SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'QUERY' WHEN 'click' THEN 'PEEK' WHEN 'error' THEN 'ERROR' ELSE 'LOGIN' END
       AS action_type, event_type, user_id, value FROM {events}
"""


def _sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, RAW_DETAILS)
    text = lambda c: F.col(c).cast("string")
    details = F.when(
        F.col("value") > 5,
        F.create_map(F.lit("kind"), text("event_type"), F.lit("token"), text("value"), F.lit("user"), text("user_id"), F.lit("pii"), text("id")),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return audit.sanitize(raw.select("id", "action_type", details.alias("details")))


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.details_fields(_audit(spark, sf_dir).select("id", "details"), ["k", "missing"])


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _usage(spark, sf_dir).where(F.col("event_type") == usage.QUERY)
    refused = usage.refused_requests(queries, view(spark, sf_dir, LIMITS), DAILY_LIMIT)
    return refused.select("id", "tenant_id", "day", "daily_limit")


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _usage(spark, sf_dir).where(F.col("event_type") == usage.QUERY)
    accepted = usage.accepted_requests(queries, view(spark, sf_dir, LIMITS), DAILY_LIMIT)
    return accepted.select("id", "tenant_id", "day", "request_no", "daily_limit")


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _usage(spark, sf_dir).where(F.col("event_type") == usage.QUERY)
    return usage.quota_status(queries, view(spark, sf_dir, LIMITS), DAILY_LIMIT)


def _run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _usage(spark, sf_dir)
    return usage.run_counters(events, F.when(F.col("event_type") == "error", F.lit("failed")))


CATALOG_ROWS = """
SELECT concat('tenant-', user_id) AS tenant_id, concat('metric-', event_id) AS name,
       CASE event_type WHEN 'view' THEN 'approved' WHEN 'click' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status
FROM {events}
"""

STEPS = """
SELECT user_id AS plan_id, event_id AS step_id,
       CASE event_type WHEN 'view' THEN 'run_stats' WHEN 'error' THEN 'guess' ELSE 'run_metric' END AS action,
       CASE event_type WHEN 'view' THEN 'trend' WHEN 'click' THEN 'total_value' WHEN 'error' THEN 'row_count'
            WHEN 'signup' THEN CASE WHEN value > 90 THEN 'total_user_id' ELSE 'max_value' END ELSE 'value_by_event_type' END AS target,
       CASE WHEN value < 1 THEN 'loose' WHEN value < 30 THEN 'orders_customers' END AS join_policy
FROM {events}
"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = small_frame(spark, [{"name": t} for t in TOOLS], "name string")
    policies = small_frame(spark, [{"name": "orders_customers"}], "name string")
    return steps.validate_step_table(view(spark, sf_dir, STEPS), generated(spark, sf_dir, "events"), tools, policies)


RUNS = """
SELECT concat(CASE WHEN role = 'assistant' THEN 's' WHEN turn = 0 THEN 'p' ELSE 'a' END, conv_id, '-', turn) AS id,
       CASE WHEN length(text) < 60 THEN 'no_match' WHEN length(text) < 120 THEN 'single_metric' WHEN length(text) < 200 THEN 'unknown'
            ELSE 'stats_tool' END AS plan_type,
       text AS answer, CASE WHEN turn > 4 THEN 'n/a' ELSE 'high' END AS confidence,
       CASE WHEN turn = 6 THEN 'TimeoutError: slow' END AS error, role, turn
FROM {conversations}
"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, RUNS)
    user = F.col("role") == "user"
    allowed = F.when(user, F.array(F.lit("no_match"), F.lit("propose_metric"))).otherwise(
        F.array(F.lit("single_metric"), F.lit("stats_tool"), F.lit("unknown"))
    )
    expect = F.struct(
        allowed.alias("plan_types_allowed"),
        (F.col("turn") == 1).alias("must_include_numbers"),
        F.array(F.lit("THE OF"), F.lit(" que ")).alias("forbidden_substrings"),
        F.lit(None).cast("string").alias("min_confidence"),
        F.lit(True).alias("check_pii"),
    )
    return evaluation.grade(runs.withColumn("expect", expect))


GRADED = """
SELECT id, error, list_filter([
    CASE WHEN error IS NOT NULL THEN 'error: ' || error END,
    CASE WHEN role = 'user' AND plan_type NOT IN ('no_match', 'propose_metric') AND NOT (plan_type = 'unknown'
              AND (confidence = 'n/a' OR contains(lower(answer), 'don''t') OR contains(lower(answer), 'no') OR contains(lower(answer), 'reliable')))
         THEN 'plan_type=' || plan_type || ' not in [no_match, propose_metric]'
         WHEN role <> 'user' AND plan_type NOT IN ('single_metric', 'stats_tool', 'unknown')
         THEN 'plan_type=' || plan_type || ' not in [single_metric, stats_tool, unknown]' END,
    CASE WHEN contains(lower(answer), 'the of') THEN 'forbidden_substring_in_answer: THE OF' END,
    CASE WHEN contains(lower(answer), ' que ') THEN 'forbidden_substring_in_answer:  que ' END,
    CASE WHEN turn = 1 AND NOT regexp_matches(answer, '\\p{Nd}') THEN 'no_numbers_in_answer' END,
    CASE WHEN regexp_matches(answer, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b')
           OR regexp_matches(answer, '\\b(?:\\+?\\d[\\d\\-\\s]{7,}\\d)\\b')
           OR regexp_matches(answer, '(?i)\\b\\d{1,5}\\s+[A-Za-z][A-Za-z\\s]+(?:St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Ln|Lane|Blvd|Boulevard|Way|Ct|Court|Pkwy|Parkway)\\b')
         THEN 'pii_leak_in_answer' END], lambda r: r IS NOT NULL) AS reasons FROM runs
"""


def _grade_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("id", F.concat_ws("; ", "reasons").alias("reasons"), "pass")


def _seen(spark: SparkSession, sf_dir: str, rows: int):
    """The id of the last of the newest rows, as a reader of the pages before would know it."""
    return audit.page(_audit(spark, sf_dir), rows).agg(F.min("id")).scalar()


QUERIES = {
    "audit_sanitize": _sanitize,
    "audit_search": lambda s, d: audit.search(_audit(s, d), username="user-7", action_type="QUERY").select("id", "timestamp", "username", "action_type", "tenant_id"),
    "audit_lookback": lambda s, d: audit.since(_audit(s, d), _now(), 7).select("id", "timestamp", "username"),
    "audit_export": lambda s, d: audit.export(_audit(s, d), "tenant-7", _now(), 10),
    "audit_page": lambda s, d: audit.page(_audit(s, d), 50, 100).select("id", "timestamp", "username", "action_type"),
    "audit_page_before": lambda s, d: audit.page_before(_audit(s, d), _seen(s, d, 100)).select("id", "timestamp", "username", "action_type"),
    "audit_stats": lambda s, d: audit.stats(_audit(s, d)),
    "details_json": _details,
    "tenant_scope": lambda s, d: guards.tenant_scope(_audit(s, d), " tenant-7 ").select("id", "tenant_id", "username"),
    "events_recent": lambda s, d: usage.recent_events(_usage(s, d), "llm_call", 100).select("id", "timestamp", "tenant_id", "event_type"),
    "usage_summary": lambda s, d: usage.usage_summary(_usage(s, d), _now(), 14),
    "usage_daily": lambda s, d: usage.daily_usage(_usage(s, d)),
    "run_counters": _run_counters,
    "quota_exceeded": _quota,
    "quota_accepted": _accepted,
    "quota_refused": _refused,
    "limit_breaches": lambda s, d: limits.limit_breaches(view(s, d, LIMITED_RUNS), view(s, d, TENANT_LIMITS)),
    "catalog_counts": lambda s, d: catalog.status_counts(view(s, d, CATALOG_ROWS)),
    "steps_validate": _steps,
    "grade_cases": _grade_cases,
    "trust_summary": lambda s, d: evaluation.trust_summary(_graded(s, d)),
}

LIMITED = f"""SELECT u.id, u.tenant_id, CAST(u.timestamp AS DATE) AS day, CAST(coalesce(l.daily_limit, {DAILY_LIMIT}) AS BIGINT) AS daily_limit,
    CAST(row_number() OVER (PARTITION BY u.tenant_id, CAST(u.timestamp AS DATE) ORDER BY u.timestamp, u.id) AS BIGINT) AS request_no
    FROM u LEFT JOIN l ON u.tenant_id = l.tenant_id WHERE u.event_type = 'query'"""

ORACLES = {
    "audit_sanitize": oracle(
        """SELECT id, action_type, CASE WHEN value > 5 THEN '{"kind":"' || event_type || '","user":"' || user_id || '"}' END AS details
           FROM r WHERE action_type <> 'PEEK'""",
        r=RAW_DETAILS,
    ),
    "audit_search": oracle("SELECT id, timestamp, username, action_type, tenant_id FROM a WHERE username = 'user-7' AND action_type = 'QUERY'", a=AUDIT),
    "audit_lookback": oracle(f"SELECT id, timestamp, username FROM a WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY", a=AUDIT),
    "audit_export": oracle(f"SELECT * FROM a WHERE tenant_id = 'tenant-7' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY", a=AUDIT),
    "audit_page_before": oracle("SELECT id, timestamp, username, action_type FROM a ORDER BY id DESC LIMIT 50 OFFSET 100", a=AUDIT),
    "audit_page": oracle("SELECT id, timestamp, username, action_type FROM a ORDER BY id DESC LIMIT 50 OFFSET 100", a=AUDIT),
    "audit_stats": oracle(
        """SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM a
           UNION ALL SELECT 'action', action_type, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'user', username, count(*) FROM a GROUP BY 2""",
        a=AUDIT,
    ),
    "details_json": oracle("SELECT id, details, json_extract_string(details, '$.k') AS k, json_extract_string(details, '$.missing') AS missing FROM a", a=AUDIT),
    "tenant_scope": oracle("SELECT id, tenant_id, username FROM a WHERE tenant_id = 'tenant-7'", a=AUDIT),
    "events_recent": oracle("SELECT id, timestamp, tenant_id, event_type FROM u WHERE event_type = 'llm_call' ORDER BY timestamp DESC, id DESC LIMIT 100", u=USAGE),
    "usage_summary": oracle(f"SELECT tenant_id, event_type, count(*) AS n FROM u WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY 1, 2", u=USAGE),
    "usage_daily": oracle(
        """SELECT tenant_id, CAST(timestamp AS DATE) AS day, count(*) FILTER (event_type = 'query') AS queries,
           count(*) FILTER (event_type = 'llm_call') AS llm_calls, count(*) FILTER (event_type = 'upload') AS uploads,
           CAST(sum(rows_scanned) AS BIGINT) AS rows_scanned FROM u GROUP BY 1, 2""",
        u=USAGE,
    ),
    "run_counters": oracle(
        """SELECT tenant_id, count(*) AS total_runs, count(*) FILTER (event_type = 'error') AS errors,
           count(*) FILTER (event_type <> 'error') AS successes FROM u GROUP BY 1""",
        u=USAGE,
    ),
    "quota_exceeded": oracle(
        f"""SELECT tenant_id, day, count(*) AS requests, daily_limit, count(*) FILTER (request_no <= daily_limit) AS accepted,
           count(*) FILTER (request_no > daily_limit) AS refused, count(*) FILTER (request_no > daily_limit) > 0 AS exceeded
           FROM ({LIMITED}) GROUP BY tenant_id, day, daily_limit""",
        u=USAGE, l=LIMITS,
    ),
    "quota_accepted": oracle(f"SELECT id, tenant_id, day, request_no, daily_limit FROM ({LIMITED}) WHERE request_no <= daily_limit", u=USAGE, l=LIMITS),
    "quota_refused": oracle(f"SELECT id, tenant_id, day, daily_limit FROM ({LIMITED}) WHERE request_no > daily_limit", u=USAGE, l=LIMITS),
    "limit_breaches": oracle(
        """SELECT r.tenant_id, id, name AS limit, used, allowed FROM r LEFT JOIN t ON r.tenant_id = t.tenant_id, LATERAL (
             SELECT 'max_rows_per_query' AS name, CAST(rows AS DOUBLE) AS used, CAST(coalesce(max_rows_per_query, 100000) AS DOUBLE) AS allowed
             UNION ALL SELECT 'max_plan_steps', CAST(plan_steps AS DOUBLE), 3.0
             UNION ALL SELECT 'query_timeout_seconds', CAST(seconds AS DOUBLE), CAST(coalesce(query_timeout_seconds, 30) AS DOUBLE)
           ) WHERE used > allowed AND (allowed > 0 OR name = 'max_plan_steps')""",
        r=LIMITED_RUNS, t=TENANT_LIMITS,
    ),
    "catalog_counts": oracle(
        """SELECT tenant_id, count(*) FILTER (status = 'approved') AS approved_count, count(*) FILTER (status = 'pending') AS pending_count
           FROM c GROUP BY 1""",
        c=CATALOG_ROWS,
    ),
    "steps_validate": oracle(
        """SELECT plan_id, count(*) AS steps, bool_and((CASE WHEN action = 'run_stats' THEN target IN ('trend')
             ELSE target IN ('total_value', 'row_count', 'max_value', 'value_by_event_type') END)
             AND coalesce(join_policy, 'orders_customers') = 'orders_customers') AS ok FROM s GROUP BY 1""",
        s=STEPS,
    ),
    "grade_cases": oracle("SELECT id, array_to_string(reasons, '; ') AS reasons, len(reasons) = 0 AS pass FROM g", runs=RUNS, g=GRADED),
    "trust_summary": oracle(
        """SELECT count(*) AS total, count(*) FILTER (len(reasons) = 0) AS passed,
             round(count(*) FILTER (len(reasons) = 0) / count(*), 4) AS pass_rate,
             count(*) FILTER (list_contains(reasons, 'pii_leak_in_answer')) AS pii_leak_count,
             round(count(*) FILTER (list_contains(reasons, 'pii_leak_in_answer')) / greatest(count(*) FILTER (id LIKE 'p%'), 1), 4) AS pii_leak_rate,
             count(*) FILTER (error <> '') AS error_count, round(count(*) FILTER (error <> '') / count(*), 4) AS error_rate,
             round(count(*) FILTER (id LIKE 'a%' AND len(reasons) = 0) / greatest(count(*) FILTER (id LIKE 'a%'), 1), 4) AS refusal_correctness
           FROM g""",
        runs=RUNS, g=GRADED,
    ),
}

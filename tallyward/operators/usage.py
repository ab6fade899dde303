"""Usage per tenant: summaries, daily counters, quotas, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.errors import QuotaExceededError
from tallyward.operators.audit import since
from tallyward.operators.topn import first_per_key, newest_page

# ---- Fixed values ---------------------------------------------------------------------------------------
DEFAULT_LIMITS = {
    "max_queries_per_day": 500, "max_llm_calls_per_day": 1000, "max_rows_per_query": 100_000,
    "max_file_size_mb": 50, "max_plan_steps": 3, "query_timeout_seconds": 30,
}
RECENT_EVENTS = 100
SUMMARY_DAYS = 30
TURNS_PER_SESSION = 5
# ---------------------------------------------------------------------------------------------------------

QUERIES_PER_DAY = DEFAULT_LIMITS["max_queries_per_day"]
QUERY, LLM_CALL, UPLOAD = "query", "llm_call", "upload"
MINUTE = ("tenant_id", "day", "_minute")
# Minutes of a tenant with more rows are put in order in parts: at most MAX_SLOTS, cut at each FENCE_STEPS-th chosen row.
GROUP_ROWS = 500_000
MAX_SLOTS, FENCE_STEPS = 256, 8


def recent_events(
    events: DataFrame,
    event_type: str | None = None,
    limit: int = RECENT_EVENTS,
    ts_col: str = "timestamp",
    id_col: str = "id",
) -> DataFrame:
    """Newest events, after the filter on their type."""
    if event_type:
        events = events.where(F.col("event_type") == event_type)
    return newest_page(events, [F.desc(ts_col), F.desc(id_col)], limit)


def usage_summary(events: DataFrame, now: Column, days: int = SUMMARY_DAYS, ts_col: str = "timestamp") -> DataFrame:
    """(tenant_id, event_type, n) over the last days."""
    return since(events, now, days, ts_col).groupBy("tenant_id", "event_type").agg(F.count("*").alias("n"))


def run_counters(runs: DataFrame, error: Column) -> DataFrame:
    """(tenant_id, total_runs, errors, successes); a run with a non-empty error is an error."""
    failed = F.coalesce(error != "", F.lit(False))
    return runs.groupBy("tenant_id").agg(
        F.count("*").alias("total_runs"), F.count_if(failed).alias("errors"), F.count_if(~failed).alias("successes")
    )


def daily_counters() -> list[Column]:
    """The counters of one tenant and day, for batch and streaming aggregation alike."""
    kind = F.col("event_type")
    return [
        F.count_if(kind == QUERY).alias("queries"),
        F.count_if(kind == LLM_CALL).alias("llm_calls"),
        F.count_if(kind == UPLOAD).alias("uploads"),
        F.coalesce(F.sum("rows_scanned"), F.lit(0)).alias("rows_scanned"),
    ]


def daily_usage(events: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """(tenant_id, day, queries, llm_calls, uploads, rows_scanned) by UTC day."""
    return events.groupBy("tenant_id", F.to_date(ts_col).alias("day")).agg(*daily_counters())


def day_text(ts: Column) -> Column:
    """The key of a UTC day."""
    return F.date_format(ts, "yyyy-MM-dd")


def _begun(requests: DataFrame, limits: DataFrame | None, default_limit: int, ts_col: str, id_col: str, group_rows: int) -> DataFrame:
    """The rows with the `_minute` and `_slot` they fall in, the number of requests `_before` these and the `daily_limit`.

    A tenant's day is never sorted whole, whatever its limit: requests are counted per minute, the counts, at most
    1,440 a day, give each minute the number it starts from, and only the rows of a minute are put in order. Minutes of over
    `group_rows` rows are cut into slots first; a job that counts the minutes finds out whether there are any.
    """
    timed = requests.withColumns({"day": F.to_date(ts_col), "_minute": F.date_trunc("minute", F.col(ts_col))})
    crowded = timed.groupBy(*MINUTE).agg(F.count("*").alias("_n")).where(F.col("_n") > group_rows)
    if crowded.isEmpty():
        timed = timed.withColumn("_slot", F.lit(0))
    else:
        timed = _with_slots(timed, crowded, ts_col, id_col, group_rows)
    counts = timed.groupBy(*MINUTE, "_slot").agg(F.count("*").alias("_n"))
    if limits is None:
        counts = counts.withColumn("daily_limit", F.lit(default_limit).cast("bigint"))
    else:
        counts = _with_limit(counts, limits, default_limit)
    before = Window.partitionBy("tenant_id", "day").orderBy("_minute", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return timed.alias("r").join(starts.alias("s"), _same("r", "s", *MINUTE, "_slot")).select("r.*", "s._before", "s.daily_limit")


def _same(left: str, right: str, *keys: str) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def _with_slots(timed: DataFrame, crowded: DataFrame, ts_col: str, id_col: str, group_rows: int) -> DataFrame:
    """Rows of crowded minutes get a `_slot` from 0 by time, then id; other minutes are one slot.

    Slots are cut at fences: every FENCE_STEPS-th of the rows that a hash chooses, so that a slot has about a quarter of
    `group_rows`, or one in MAX_SLOTS of a larger minute. The fences only decide which rows are put in order together; the
    numbers do not depend on them. Rows at one instant are told apart by their id.
    """
    at = F.struct(F.col(f"r.{ts_col}").alias("ts"), F.col(f"r.{id_col}").alias("id"))
    share = FENCE_STEPS * F.least(F.lit(float(MAX_SLOTS)), 4.0 * F.col("_n") / group_rows) / F.col("_n")
    chance = F.pmod(F.xxhash64(f"r.{id_col}", f"r.{ts_col}"), F.lit(1 << 30)) / float(1 << 30)
    chosen = timed.alias("r").join(crowded.alias("c"), _same("r", "c", *MINUTE)).where(chance < share)
    every = F.array_sort(F.collect_list("at"))
    fences = chosen.select(*[f"c.{k}" for k in MINUTE], at.alias("at")).groupBy(*MINUTE).agg(
        F.filter(every, lambda _, i: i % FENCE_STEPS == FENCE_STEPS - 1).alias("_fences")
    )
    joined = timed.alias("r").join(fences.alias("f"), _same("r", "f", *MINUTE), "left")
    slot = F.when(F.col("_fences").isNotNull(), F.size(F.filter("_fences", lambda fence: fence <= at))).otherwise(F.lit(0))
    return joined.select("r.*", slot.alias("_slot"))


def _request_no(begun: DataFrame, ts_col: str, id_col: str) -> DataFrame:
    within = Window.partitionBy(*MINUTE, "_slot").orderBy(F.asc(ts_col), F.asc(id_col))
    number = (F.col("_before") + F.row_number().over(within)).cast("bigint")
    return begun.withColumn("request_no", number).drop("_before", "_minute", "_slot")


def accepted_requests(
    requests: DataFrame,
    limits: DataFrame | None = None,
    default_limit: int = QUERIES_PER_DAY,
    ts_col: str = "timestamp",
    id_col: str = "id",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The requests a daily quota lets through, numbered from 1 per tenant and day in `request_no`.

    `limits` (tenant_id, daily_limit) overrides the default. A refused request is not counted. Minutes and slots that begin with
    the quota used up are not put in order.
    """
    begun = _begun(requests, limits, default_limit, ts_col, id_col, group_rows).where(F.col("_before") < F.col("daily_limit"))
    accepted = _request_no(begun, ts_col, id_col).where(F.col("request_no") <= F.col("daily_limit"))
    return accepted.drop("daily_limit") if limits is None else accepted


def refused_requests(
    requests: DataFrame,
    limits: DataFrame | None = None,
    default_limit: int = QUERIES_PER_DAY,
    ts_col: str = "timestamp",
    id_col: str = "id",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The requests over the daily quota: those that come after the last accepted one of their tenant and day."""
    begun = _begun(requests, limits, default_limit, ts_col, id_col, group_rows)
    return _request_no(begun, ts_col, id_col).where(F.col("request_no") > F.col("daily_limit")).drop("request_no")


def _with_limit(rows: DataFrame, limits: DataFrame, default_limit: int) -> DataFrame:
    own = limits.select("tenant_id", F.col("daily_limit").cast("bigint").alias("daily_limit"))
    joined = rows.join(own, "tenant_id", "left")
    return joined.withColumn("daily_limit", F.coalesce("daily_limit", F.lit(default_limit).cast("bigint")))


def quota_status(
    requests: DataFrame,
    limits: DataFrame | None = None,
    default_limit: int = QUERIES_PER_DAY,
    ts_col: str = "timestamp",
) -> DataFrame:
    """(tenant_id, day, requests, daily_limit, accepted, refused, exceeded); a plain count, no ordering needed."""
    counts = requests.groupBy("tenant_id", F.to_date(ts_col).alias("day")).agg(F.count("*").alias("requests"))
    if limits is None:
        limited = counts.withColumn("daily_limit", F.lit(default_limit).cast("bigint"))
    else:
        limited = _with_limit(counts, limits, default_limit)
    accepted = F.least("requests", F.greatest("daily_limit", F.lit(0)).cast("bigint"))
    return limited.withColumns(
        {"accepted": accepted, "refused": F.col("requests") - accepted, "exceeded": F.col("requests") > accepted}
    ).select("tenant_id", "day", "requests", "daily_limit", "accepted", "refused", "exceeded")


def check_quota(used: int, limit: int, tenant_id: str) -> None:
    """Raise when a tenant has used up its daily limit."""
    if used >= limit:
        raise QuotaExceededError(f"tenant {tenant_id!r} is over its daily limit of {limit}")


# ---- sessions -------------------------------------------------------------------------------------------


def last_turns(turns: DataFrame, session_col: str, turn_col: str, n: int = TURNS_PER_SESSION) -> DataFrame:
    """The last turns of every session; `back` counts from 1 for the newest."""
    return first_per_key(turns, [session_col], [F.desc(turn_col)], n, "back")


def turn_line(question: Column, plan_type: Column, target: Column, groupby: Column, filters: Column) -> Column:
    """One line of context about a turn. Fixed format."""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    have = lambda c: F.coalesce(c != "", F.lit(False))
    return F.concat(
        F.lit("Previous question: "), quoted(question),
        F.when(have(target), F.concat(F.lit(" -> used "), plan_type, F.lit(" on "), quoted(target))).otherwise(F.lit("")),
        F.when(have(groupby), F.concat(F.lit(" grouped by "), quoted(groupby))).otherwise(F.lit("")),
        F.when(have(filters), F.concat(F.lit(" with filters "), filters)).otherwise(F.lit("")),
    )


def session_context(turns: DataFrame, session_col: str, turn_col: str, line: Column, n: int = TURNS_PER_SESSION) -> DataFrame:
    """(session, context): the lines of the last turns, oldest first. Only those few rows per session meet."""
    recent = last_turns(turns.withColumn("_line", line), session_col, turn_col, n)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("at"), F.col("_line").alias("line"))))
    return recent.groupBy(session_col).agg(F.array_join(F.transform(ordered, lambda t: t["line"]), "\n").alias("context"))

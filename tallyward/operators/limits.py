"""What each tenant may use: rows, megabytes, steps and seconds of a run, next to the daily quotas of `usage`."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators.guards import inline_rows, tenant_scope, text_literal
from tallyward.operators.usage import DEFAULT_LIMITS

# What a run's columns are held against.
RUN_LIMITS = {"rows": "max_rows_per_query", "file_mb": "max_file_size_mb", "plan_steps": "max_plan_steps", "seconds": "query_timeout_seconds"}


@dataclass(frozen=True)
class TenantLimits:
    """One tenant's limits; zero or less is no limit on rows and seconds."""

    max_queries_per_day: int = DEFAULT_LIMITS["max_queries_per_day"]
    max_llm_calls_per_day: int = DEFAULT_LIMITS["max_llm_calls_per_day"]
    max_rows_per_query: int = DEFAULT_LIMITS["max_rows_per_query"]
    max_file_size_mb: float = DEFAULT_LIMITS["max_file_size_mb"]
    max_plan_steps: int = DEFAULT_LIMITS["max_plan_steps"]
    query_timeout_seconds: float = DEFAULT_LIMITS["query_timeout_seconds"]


def limits_of(limits: DataFrame, tenant_id: str | None) -> TenantLimits:
    """A tenant's row of a table (tenant_id, any limits by name); what it does not hold, or holds as null, is the default.

    A tenant with several rows has the strictest of each. One bounded job.
    """
    known = [f.name for f in fields(TenantLimits) if f.name in limits.columns]
    mine = tenant_scope(limits, tenant_id)
    if not known:
        return TenantLimits()
    row = mine.agg(*[F.min(n).alias(n) for n in known]).first()
    return TenantLimits(**{n: row[n] for n in known if row[n] is not None})


def limit_breaches(runs: DataFrame, limits: DataFrame, id_col: str = "id") -> DataFrame:
    """(tenant_id, id, limit, used, allowed): a row for each limit that a run went over.

    `runs` has a tenant_id and any of rows, file_mb, plan_steps and seconds; a null of these is over no limit. `limits` is as for
    `limits_of`. Runs of no known tenant are held against the defaults.
    """
    used = {c: n for c, n in RUN_LIMITS.items() if c in runs.columns}
    if not used:
        raise ValueError(f"runs have none of {sorted(RUN_LIMITS)}")
    own = [n for n in used.values() if n in limits.columns]
    strictest = limits.where(F.col("tenant_id").isNotNull()).groupBy("tenant_id").agg(F.count("*"), *[F.min(n).alias(f"_{n}") for n in own])
    joined = runs.select("tenant_id", id_col, *used).join(strictest.select("tenant_id", *[f"_{n}" for n in own]), "tenant_id", "left")
    allowed = lambda n: f"coalesce(CAST(_{n} AS DOUBLE), {float(DEFAULT_LIMITS[n])}D)" if n in own else f"{float(DEFAULT_LIMITS[n])}D"
    cells = [{"limit": text_literal(n), "used": f"CAST({c} AS DOUBLE)", "allowed": allowed(n)} for c, n in used.items()]
    return joined.select("tenant_id", id_col, inline_rows(cells)).where("used > allowed AND (allowed > 0 OR limit IN ('max_file_size_mb', 'max_plan_steps'))")

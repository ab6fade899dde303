"""Audit rows: what may be written, how they are searched, paged, exported and counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.operators.guards import require_tenant, tenant_scope
from tallyward.operators.topn import newest_page, page_after

# ---- Fixed values ---------------------------------------------------------------------------------------
ACTION_TYPES = (
    "LOGIN", "LOGOUT", "QUERY", "METRIC_RESOLVE", "DATA_RESEED", "PII_ACCESS", "ERROR",
    "METRIC_PROPOSE", "METRIC_APPROVE", "METRIC_REJECT",
)
SECRET_KEYS = ("raw_data", "pii", "password", "token")
EXPORT_COLUMNS = ("id", "timestamp", "username", "role", "action_type", "details", "ip_address", "tenant_id")
PAGE_ROWS = 50
EXPORT_DAYS = 30
# ---------------------------------------------------------------------------------------------------------


def without_secrets(details: Column) -> Column:
    """A details map without the keys that must never be stored."""
    return F.map_filter(details, lambda key, _: ~key.isin(*SECRET_KEYS))


def valid_action(action_type: Column) -> Column:
    """Is the action one of the known types? False for null."""
    return F.coalesce(action_type.isin(*ACTION_TYPES), F.lit(False))


def sanitize(rows: DataFrame) -> DataFrame:
    """Rows ready to be stored: known actions only, details clean."""
    return with_clean_details(rows.where(valid_action(F.col("action_type"))))


def with_clean_details(rows: DataFrame) -> DataFrame:
    """Details stripped of secrets and as JSON text; null when empty."""
    details = F.when(F.size("details") > 0, F.to_json(without_secrets(F.col("details"))))
    return rows.withColumn("details", details)


def rejected(rows: DataFrame) -> DataFrame:
    """Rows whose action type is unknown."""
    return rows.where(~valid_action(F.col("action_type")))


def search(rows: DataFrame, username: str | None = None, action_type: str | None = None, tenant_id: str | None = None) -> DataFrame:
    """Rows that equal every criterion given."""
    for column, value in (("username", username), ("action_type", action_type), ("tenant_id", tenant_id)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def page(rows: DataFrame, limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """Newest first."""
    return newest_page(rows, [F.desc("id")], limit, offset)


def page_before(rows: DataFrame, last_id: object | None, limit: int = PAGE_ROWS) -> DataFrame:
    """The page of a newest-first listing that follows the row of an id, the first one without it. Deep pages cost what the first does."""
    return page_after(rows, [("id", True)], None if last_id is None else [last_id], limit)


def since(rows: DataFrame, now: Column, days: int, ts_col: str = "timestamp") -> DataFrame:
    """Rows of the last `days` days before `now`; both ends are plain values, so the filter reaches the scan."""
    return rows.where(F.col(ts_col) >= now - F.make_dt_interval(F.lit(days)))


def export(rows: DataFrame, tenant_id: str, now: Column, days: int = EXPORT_DAYS) -> DataFrame:
    """One tenant's recent rows, newest first, in the export's column order."""
    require_tenant(tenant_id)
    recent = since(tenant_scope(rows, tenant_id), now, days)
    return recent.select(*[c for c in EXPORT_COLUMNS if c in rows.columns]).orderBy(F.desc("id"))


def stats(rows: DataFrame) -> DataFrame:
    """(section, key, n): the total, counts by action and counts by user, from one pass."""
    counted = rows.groupingSets([[], ["action_type"], ["username"]], "action_type", "username").agg(
        F.grouping_id().alias("_set"), F.count("*").alias("n")
    )
    # grouping_id: 3 leaves both columns out, 1 the user, 2 the action.
    section = F.when(F.col("_set") == 3, "total").when(F.col("_set") == 1, "action").otherwise("user")
    key = F.when(F.col("_set") == 1, F.col("action_type")).when(F.col("_set") == 2, F.col("username"))
    return counted.select(section.alias("section"), key.alias("key"), "n").orderBy("section", F.desc("n"), "key")


def details_fields(rows: DataFrame, fields: Sequence[str], details_col: str = "details") -> DataFrame:
    """Adds text columns for top-level fields of JSON details."""
    return rows.withColumns({f: F.get_json_object(F.col(details_col), f"$.{f}") for f in fields})

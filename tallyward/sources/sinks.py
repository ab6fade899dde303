"""Append-only tables: telemetry, audit, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators import audit

TELEMETRY_SCHEMA = "timestamp timestamp, tenant_id string, event_type string, details map<string,string>"
AUDIT_SCHEMA = (
    "id bigint, timestamp timestamp, username string, role string, action_type string, details string, "
    "ip_address string, tenant_id string"
)
UNKNOWN_ACTION = "unknown action_type"
EXPORT_FORMATS = ("csv", "json")


def append_telemetry(events: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Append events, a folder per tenant, so that a tenant's reads touch only its own files."""
    _by_tenant(events.select("timestamp", "tenant_id", "event_type", "details")).write.partitionBy("tenant_id").mode(
        "append"
    ).format(file_format).save(path)


def _by_tenant(rows: DataFrame) -> DataFrame:
    # Rebalancing by tenant keeps files few; Spark splits the parts of a large tenant again.
    return rows.hint("rebalance", "tenant_id")


def read_telemetry(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """The telemetry table."""
    return spark.read.schema(TELEMETRY_SCHEMA).format(file_format).load(path)


def append_audit(rows: DataFrame, path: str, now: Column | None = None) -> None:
    """Append audit rows. Fails, writing nothing, if any row has an unknown action type; drops secret details.

    The check is part of the write, so the rows are read once and what is written is what was checked.
    """
    checked = F.when(audit.valid_action(F.col("action_type")), F.col("action_type")).otherwise(
        F.raise_error(F.concat(F.lit(UNKNOWN_ACTION + " "), F.coalesce("action_type", F.lit("null"))))
    )
    stamped = audit.with_clean_details(rows).withColumn("action_type", checked)
    if "timestamp" not in stamped.columns:
        stamped = stamped.withColumn("timestamp", F.current_timestamp() if now is None else now)
    try:
        _by_tenant(stamped).write.partitionBy("tenant_id").mode("append").parquet(path)
    except Exception as error:
        if UNKNOWN_ACTION in str(error):
            raise ValueError(f"unknown action_type; known: {sorted(audit.ACTION_TYPES)}") from error
        raise


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit table."""
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def export_audit(rows: DataFrame, path: str, tenant_id: str, now: Column, days: int = audit.EXPORT_DAYS, file_format: str = "json") -> None:
    """Write one tenant's recent rows in the export's column order."""
    if file_format not in EXPORT_FORMATS:
        raise ValueError(f"format must be one of {EXPORT_FORMATS}")
    writer = audit.export(rows, tenant_id, now, days).write.mode("errorifexists")
    if file_format == "csv":
        # A quote inside JSON details is doubled, the usual form of CSV.
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.json(path)

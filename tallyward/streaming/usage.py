"""Daily usage counters over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.operators.usage import daily_counters, daily_usage
from tallyward.streaming.batches import COMPACT_EVERY, BatchTable

LATENESS = "1 hour"
COUNTERS = ("queries", "llm_calls", "uploads", "rows_scanned")
KEYS = ["tenant_id", "day"]
MERGES = {counter: F.sum for counter in COUNTERS}


def daily_usage_stream(events: DataFrame, ts_col: str = "timestamp", lateness: str = LATENESS) -> DataFrame:
    """(tenant_id, day, counters) per UTC day; a day is final once the watermark has passed it.

    State is one small row per tenant and open day. The time column is cast, as a watermark needs a zoned type.
    """
    timed = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, lateness)
    daily = timed.groupBy("tenant_id", F.window(ts_col, "1 day").alias("_day")).agg(*daily_counters())
    return daily.select(
        "tenant_id", F.to_date("_day.start").alias("day"), "queries", "llm_calls", "uploads", "rows_scanned"
    )


def write_all_usage(
    stream: DataFrame, path: str, checkpoint: str, ts_col: str = "timestamp", available_now: bool = True, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Start daily counters that count every event, however late: each batch adds its own counts, `read_daily_usage` sums them up.

    No state is held and a replayed batch changes nothing; a day stays open for ever. `daily_usage_stream` closes days instead,
    and drops what comes after.
    """

    def write(batch: DataFrame, number: int) -> None:
        BatchTable(batch.sparkSession, path, KEYS, MERGES).write(daily_usage(batch, ts_col), number, compact_every)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_daily_usage(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id, day, counters) of all batches so far."""
    return BatchTable(spark, path, KEYS, MERGES).read()


def dropped_rows(query: StreamingQuery) -> int:
    """How many counters of a task, tenant and day came too late for `daily_usage_stream`, in the reports that the query still holds."""
    return sum(op["numRowsDroppedByWatermark"] for report in query.recentProgress for op in report["stateOperators"])


def write_daily_usage(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished days to a Parquet table, exactly once per checkpoint folder."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)

"""Metrics that stay fresh on growing data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tallyward.operators.guards import additive, column_ref
from tallyward.operators.metrics import aggregate, equality_filter
from tallyward.plans.catalog import MetricDefinition
from tallyward.streaming.batches import COMPACT_EVERY, BatchTable, merged

WINDOWS = {"D": "1 day", "W": "7 days"}
LATENESS = "1 hour"
#: A distinct count's sketch has 2 to so many slots.
SKETCH_LOG2 = 12
SKETCHES = StructType([StructField("key", StringType()), StructField("sketch", BinaryType())])


def metric_stream(rows: DataFrame, metric: MetricDefinition) -> DataFrame:
    """A running grouped metric (key, value) over a stream; state is one row per group.

    A distinct count has no state of bounded size that is exact: `write_distinct` keeps sketches for it.
    """
    if metric.agg == "nunique":
        raise ValueError("an exact distinct count needs unbounded state; use write_distinct, or run it as a batch")
    filtered, key = _grouped(rows, metric)
    return filtered.groupBy(key).agg(aggregate(filtered, metric.column, metric.agg).alias("value"))


def _grouped(rows: DataFrame, metric: MetricDefinition) -> tuple[DataFrame, Column]:
    key = column_ref(metric.groupby).cast("string") if metric.groupby else F.lit(None).cast("string")
    return equality_filter(rows, metric.base_filters), key.alias("key")


def distinct_sketches(rows: DataFrame, metric: MetricDefinition, log2_size: int = SKETCH_LOG2) -> DataFrame:
    """(key, sketch) of the values of a metric's column; nulls do not count. Sketches of a key can be merged."""
    filtered, key = _grouped(rows, metric)
    value = F.hll_sketch_agg(column_ref(metric.column).cast("string"), F.lit(log2_size))
    return filtered.groupBy(key).agg(value.alias("sketch"))


def write_distinct(
    rows: DataFrame, metric: MetricDefinition, path: str, checkpoint: str, available_now: bool = True,
    log2_size: int = SKETCH_LOG2, compact_every: int = COMPACT_EVERY, keep: int | None = None,
) -> StreamingQuery:
    """Start a running distinct count: each batch adds a sketch a key, which are merged on reading and in snapshots.

    Nothing is held between batches but what is written, no row is late, and a replayed batch changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = BatchTable(batch.sparkSession, path, ["key"], _sketch_merges(log2_size))
        table.write(distinct_sketches(batch, metric, log2_size), number, compact_every, keep)

    return _started(rows.writeStream.foreachBatch(write), checkpoint, available_now)


def read_distinct(spark: SparkSession, path: str, log2_size: int = SKETCH_LOG2, upto: int | None = None) -> DataFrame:
    """(key, value): the estimated distinct counts. The relative standard error is about 0.8 over the square root of 2 ** log2_size,
    1.3 % unless told otherwise."""
    table = BatchTable(spark, path, ["key"], _sketch_merges(log2_size))
    return table.read(SKETCHES, upto).select("key", F.hll_sketch_estimate("sketch").alias("value"))


def _sketch_merges(log2_size: int) -> dict:
    # Sketches of another size are merged too, at the smaller one.
    return {"sketch": lambda column: F.hll_union_agg(column, F.lit(True))}


def trend_stream(rows: DataFrame, date_col: str, value_col: str, freq: str = "D", lateness: str = LATENESS) -> DataFrame:
    """A running trend (period, value, n) per day or Monday week; old periods leave the state."""
    if freq not in WINDOWS:
        raise ValueError(f"freq must be one of {sorted(WINDOWS)}")
    timed = rows.withColumn("_ts", column_ref(date_col).cast("timestamp")).withWatermark("_ts", lateness)
    # Windows count from 1970-01-01, a Thursday; four days on they start on Mondays.
    window = F.window("_ts", WINDOWS[freq], startTime="4 days") if freq == "W" else F.window("_ts", WINDOWS[freq])
    sums = timed.groupBy(window.alias("_w")).agg(F.sum(additive(rows, value_col)).alias("value"), F.count("*").alias("n"))
    return sums.select(F.to_date("_w.start").alias("period"), "value", "n")


def upsert_sink(
    path: str, keys: list[str] | None = None, compact_every: int = COMPACT_EVERY, keep: int | None = None
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that keeps the newest value of every key; the keys are the first column unless told otherwise.

    Each batch is published under its own number once, so a replay after a failure changes nothing; `read_latest` picks the newest
    batch per key. Every `compact_every` batches (0: never) the newest values so far are also published as a snapshot, after
    which `read_current` reads only the snapshot and the batches since. With `keep`, what is older than the last so many
    snapshots is removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        BatchTable(batch.sparkSession, path, keys or batch.columns[:1]).write(batch, number, compact_every, keep)

    return write


def read_latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The newest value per key from the batches of `upsert_sink`."""
    return merged(written, keys)


def read_current(spark: SparkSession, path: str, keys: list[str], schema: StructType, upto: int | None = None) -> DataFrame:
    """The newest value per key: those of the last snapshot, if there is one, overwritten by the batches since.

    Only what is published counts, and only the folders needed are read. `upto` leaves out what comes after that batch.
    """
    return BatchTable(spark, path, keys).read(schema, upto)


def write_updates(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, keys: list[str] | None = None,
    compact_every: int = COMPACT_EVERY, keep: int | None = None,
) -> StreamingQuery:
    """Start the stream in update mode into `upsert_sink`."""
    writer = stream.writeStream.outputMode("update").foreachBatch(upsert_sink(path, keys or stream.columns[:1], compact_every, keep))
    return _started(writer, checkpoint, available_now)


def _started(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

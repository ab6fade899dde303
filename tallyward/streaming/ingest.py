"""Telemetry ingest: JSON lines to a clean, partitioned table that loses nothing.

A watermark would bound the memory of ids by throwing away what comes late, a backfill in particular. Here a stream keeps no state:
each micro-batch is one of the table's batches, and ids are looked up in a table of the ids written before, by days.

* Lines without an event id can not be told to be repeats. They go straight to the table.
* Lines within the lateness, counted back from the newest event so far, are dropped if their id is there already.
* Older lines are late. They are looked up on their own days, marked `late`, and `repeated` if their id is there already; a reader
  sees who sent them and decides.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.operators.audit import without_secrets
from tallyward.operators.topn import first_per_key
from tallyward.sources.commits import CommitLog

INCOMING_SCHEMA = "event_id string, timestamp string, tenant_id string, event_type string, details map<string,string>"
LATENESS = "1 hour"
_IDS = "tenant_id string, event_id string, day date, batch bigint"


def read_telemetry_stream(spark: SparkSession, folder: str, max_files: int = 1_000) -> DataFrame:
    """New JSON-lines files of a folder."""
    return spark.readStream.schema(INCOMING_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)


def clean_telemetry(events: DataFrame) -> DataFrame:
    """Valid events without secrets, of a stream or a table.

    An event needs a tenant, a type and a readable time; a line that is no JSON has none of them.
    """
    timed = events.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    tenant = F.trim("tenant_id")
    valid = F.col("timestamp").isNotNull() & (tenant != "") & F.col("event_type").isNotNull()
    return timed.where(F.coalesce(valid, F.lit(False))).withColumns(
        {"tenant_id": tenant, "details": without_secrets(F.coalesce("details", F.create_map().cast("map<string,string>")))}
    )


class TelemetryTable:
    """The table of a stream's events below a path: a folder a batch, split by tenant, with `late` and `repeated`.

    A batch counts once its commit is there; the commit also holds how many rows were written, late and repeated, and the newest
    time so far. A replay of a committed batch does nothing, one of a batch that died before overwrites what it left.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        # Names that begin with an underscore are hidden from a plain read of the path.
        self.commits = CommitLog(spark, f"{self.path}/_batches")

    def append(self, clean: DataFrame, number: int, lateness: str = LATENESS, stream: str = "") -> None:
        """Add a batch of clean events. `stream` names the one stream that may write here: numbers of two would clash."""
        done = self.commits.read(number)
        before = self.commits.last(number)
        before = None if before is None else self.commits.read(before)
        for commit in filter(None, (done, before)):
            if commit["stream"] != stream:
                raise ValueError(f"{self.path} is written by another stream")
        if done is not None:
            return
        rows = clean.persist()
        try:
            flagged = self._flagged(rows, number, before and before["newest"], lateness)
            flagged.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{self.path}/batch={number}")
        finally:
            rows.unpersist()
        # What is counted and remembered is what was written.
        written = self.spark.read.schema(flagged.schema).option("basePath", f"{self.path}/batch={number}").parquet(f"{self.path}/batch={number}")
        ids = written.where("event_id IS NOT NULL").select("event_id", "tenant_id", F.to_date("timestamp").alias("day"))
        ids.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day", "batch"
        ).parquet(f"{self.path}/_ids")
        newest = F.date_format(F.max("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        counts = written.agg(F.count("*").alias("rows"), F.count_if("late").alias("late"), F.count_if("repeated").alias("repeated"), newest.alias("newest")).first().asDict()
        if before and before["newest"]:
            counts["newest"] = max(filter(None, (before["newest"], counts["newest"])))
        self.commits.put(number, {"batch": number, "stream": stream, **counts})

    def _flagged(self, rows: DataFrame, number: int, newest: str | None, lateness: str) -> DataFrame:
        """The rows to be written of a batch."""
        line = F.to_timestamp(F.lit(newest)) - F.expr(f"INTERVAL {lateness}")
        marked = rows.withColumn("late", F.coalesce(F.col("timestamp") < line, F.lit(False)))
        without = marked.where("event_id IS NULL").withColumn("repeated", F.lit(False))
        # Of the lines of an id in a batch one is kept: the earliest, of equals the one of the smaller content.
        content = F.to_json(F.struct("event_type", F.array_sort(F.map_entries("details"))))
        named = first_per_key(marked.where("event_id IS NOT NULL"), ["tenant_id", "event_id"], [F.col("timestamp"), content], 1).drop("position")
        days = [r["day"] for r in named.where("late").select(F.to_date("timestamp").alias("day")).distinct().collect()]
        if newest:
            day, last = self.spark.range(1).select(line.cast("date"), F.to_date(F.to_timestamp(F.lit(newest)))).first()
            days += [day + datetime.timedelta(n) for n in range((last - day).days + 1)]
        known = self.ids(sorted(set(days)), number).select("tenant_id", "event_id", F.lit(True).alias("repeated")).distinct()
        met = named.join(known, ["tenant_id", "event_id"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
        return met.where("late OR NOT repeated").unionByName(without)

    def ids(self, days: list[datetime.date], before: int) -> DataFrame:
        """(tenant_id, event_id, day, batch) of the events of some days written by batches before a number. Reads those days only."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_ids")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        folders = [f"{self.path}/_ids/day={day.isoformat()}" for day in days]
        there = [f for f in folders if system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f))]
        if not there:
            return self.spark.createDataFrame([], _IDS)
        return self.spark.read.schema(_IDS).option("basePath", f"{self.path}/_ids").parquet(*there).where(F.col("batch") < before)

    def events(self, repeated: bool = False) -> DataFrame:
        """The events of all committed batches, late repeats left out unless asked for."""
        numbers = self.commits.numbers()
        shape = (
            "event_id string, timestamp timestamp, event_type string, details map<string,string>, late boolean, repeated boolean, "
            "batch bigint, tenant_id string"
        )
        if not numbers:
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in numbers])
        return rows if repeated else rows.where("NOT repeated")

    def counts(self) -> list[dict]:
        """What each batch wrote: batch, rows, late, repeated, and the newest time up to it."""
        return [self.commits.read(n) for n in self.commits.numbers()]


def write_telemetry(clean: DataFrame, path: str, checkpoint: str, available_now: bool = True, lateness: str = LATENESS) -> StreamingQuery:
    """Append a stream of clean events to the table below a path, each once as far as can be told; see TelemetryTable."""

    def write(batch: DataFrame, number: int) -> None:
        TelemetryTable(batch.sparkSession, path).append(batch, number, lateness, checkpoint)

    writer = clean.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from tallyward.operators import stats, usage
from tallyward.plans.catalog import MetricDefinition
from tallyward.streaming import batches, ingest, live_metric
from tallyward.streaming import usage as usage_stream
from tallyward.streaming.usage import daily_usage_stream, write_daily_usage
from tests.conftest import values


def finish(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


def test_daily_usage_equals_the_batch(spark, folder):
    kinds = F.get(F.array(*[F.lit(k) for k in ("query", "llm_call", "upload", "other")]), (F.col("id") % 4).cast("int"))
    rows = spark.range(400).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id / 4 AS INT))").alias("timestamp"),
        F.concat(F.lit("t"), F.col("id") % 3).alias("tenant_id"), kinds.alias("event_type"), F.col("id").alias("rows_scanned"),
    )
    rows.where("timestamp < '2024-01-03'").coalesce(1).write.parquet(f"{folder}/in")
    rows.where("timestamp >= '2024-01-03'").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    finish(write_daily_usage(daily_usage_stream(stream), f"{folder}/out", f"{folder}/cp"))
    written = spark.read.parquet(f"{folder}/out")
    batch = usage.daily_usage(rows)
    # The last day stays open until the watermark passes it.
    last = batch.agg(F.max("day")).first()[0]
    closed = batch.where(F.col("day") < last)
    assert sorted(values(written.select(*closed.columns))) == sorted(values(closed)) and written.count() > 0


def test_ingest_cleans_and_deduplicates(spark, folder):
    good = {"event_id": "1", "timestamp": "2024-01-01T10:00:00+00:00", "tenant_id": "a", "event_type": "ask", "details": {"token": "x", "n": "1"}}
    lines = [
        json.dumps(good), json.dumps(good), "not json", json.dumps({**good, "event_id": "2", "tenant_id": "  "}),
        json.dumps({**good, "event_id": "3", "timestamp": "yesterday"}), json.dumps({**good, "event_id": "4", "tenant_id": "b", "details": None}),
        json.dumps({k: v for k, v in good.items() if k != "event_type"}),
    ]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{folder}/in")
    clean = ingest.clean_telemetry(ingest.read_telemetry_stream(spark, f"{folder}/in"))
    finish(ingest.write_telemetry(clean, f"{folder}/out", f"{folder}/cp"))
    got = spark.read.parquet(f"{folder}/out")
    assert sorted(values(got, "event_id", "tenant_id")) == [("1", "a"), ("4", "b")]
    assert {json.dumps(r["details"]) for r in got.collect()} == {'{"n": "1"}', "{}"}
    # Nothing new, so a second run writes nothing.
    again = ingest.clean_telemetry(ingest.read_telemetry_stream(spark, f"{folder}/in"))
    finish(ingest.write_telemetry(again, f"{folder}/out", f"{folder}/cp"))
    assert spark.read.parquet(f"{folder}/out").count() == 2


def test_lines_without_an_id_are_all_kept(spark, folder):
    line = {"timestamp": "2024-01-01T10:00:00+00:00", "tenant_id": "a", "event_type": "ask"}
    lines = [json.dumps({**line, "details": {"n": str(i % 4)}}) for i in range(5)] + [json.dumps({**line, "event_id": "1"})] * 2
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/in")
    clean = ingest.clean_telemetry(ingest.read_telemetry_stream(spark, f"{folder}/in"))
    finish(ingest.write_telemetry(clean, f"{folder}/out", f"{folder}/cp"))
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == 6 and got.where("event_id IS NULL").count() == 5 and "_known_by" not in got.columns


def test_live_metric_and_trend_follow_the_data(spark, folder, orders):
    rows = orders.withColumn("order_date", F.col("order_date").cast("timestamp"))
    path, metric = f"{folder}/in", MetricDefinition("m", "revenue", "sum", "region")

    def update():
        source = spark.readStream.schema(rows.schema).parquet(path)
        finish(live_metric.write_updates(live_metric.metric_stream(source, metric), f"{folder}/metric", f"{folder}/cp1"))
        weekly = live_metric.trend_stream(spark.readStream.schema(rows.schema).parquet(path), "order_date", "revenue", "W")
        finish(live_metric.write_updates(weekly, f"{folder}/trend", f"{folder}/cp2"))
        latest = live_metric.read_latest(spark.read.parquet(f"{folder}/metric"), ["key"])
        return dict(values(latest, "key", "value"))

    rows.where("order_id <= 4").coalesce(1).write.parquet(path)
    assert update() == {"North": 400.0, "South": 200.0, "East": 150.0}
    rows.where("order_id > 4").coalesce(1).write.mode("append").parquet(path)
    assert update() == {"North": 400.0, "South": 600.0, "East": 150.0, "West": 250.0}
    weekly = live_metric.read_latest(spark.read.parquet(f"{folder}/trend"), ["period"])
    assert sorted(values(weekly, "period", "value", "n")) == values(stats.trend(orders, "order_date", "revenue", "W"))


def test_snapshots_replace_the_batches_before(spark, folder):
    path, shape = f"{folder}/state", "key string, value double"
    sink = live_metric.upsert_sink(path, ["key"], 3)
    batches = [[("a", 1.0), (None, 1.0)], [("b", 2.0)], [("a", 3.0)], [("c", 4.0)], [("b", 5.0)], [(None, 6.0)], [("a", 7.0)]]
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, shape)
        sink(frame, number)
        sink(frame, number)  # a replay changes nothing
    current = live_metric.read_current(spark, path, ["key"], frame.schema)
    assert sorted(values(current), key=str) == [("a", 7.0), ("b", 5.0), ("c", 4.0), (None, 6.0)]
    files = current.inputFiles()
    assert any("upto=5" in f for f in files)
    batch = live_metric.read_current(spark, path, ["key"], frame.schema, upto=2)
    assert sorted(values(batch), key=str) == [("a", 3.0), ("b", 2.0), (None, 1.0)]


def lines_of(day, ids, **more):
    return [json.dumps({"timestamp": f"2024-01-{day:02d}T10:00:0{n}+00:00", "tenant_id": "a", "event_type": "ask", **({"event_id": i} if i else {}), **more}) for n, i in enumerate(ids)]


def test_late_lines_and_backfills_are_kept(spark, folder):
    """Three files read one at a time, of days 10, 11 and 5; nothing vanishes."""
    table = ingest.TelemetryTable(spark, f"{folder}/out")
    files = [(10, ["1", "2", None]), (11, ["3", "4"]), (5, ["5", None, "6"])]
    for day, ids in files:
        spark.createDataFrame([(x,) for x in lines_of(day, ids)], "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
        stream = ingest.clean_telemetry(ingest.read_telemetry_stream(spark, f"{folder}/in", 1))
        finish(ingest.write_telemetry(stream, f"{folder}/out", f"{folder}/cp"))
    assert spark.read.parquet(f"{folder}/out").count() == table.events().count() == 8
    assert [(c["rows"], c["late"], c["repeated"]) for c in table.counts()] == [(3, 0, 0), (2, 0, 0), (3, 3, 0)]
    # Ids of day 11 again, on time, and of days 5 and 10, late, with one that is new.
    for ids, day in ((["3", "7"], 11), (["5", "8"], 5), (["1"], 10)):
        spark.createDataFrame([(x,) for x in lines_of(day, ids)], "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
    stream = ingest.clean_telemetry(ingest.read_telemetry_stream(spark, f"{folder}/in", 1))
    finish(ingest.write_telemetry(stream, f"{folder}/out", f"{folder}/cp"))
    assert sorted(values(table.events().where("event_id IS NOT NULL"), "event_id")) == [(str(n),) for n in range(1, 9)]
    assert sorted(values(table.events(repeated=True).where("repeated"), "event_id", "late")) == [("1", True), ("5", True)]


def test_batches_of_telemetry_are_written_once(spark, folder):
    table, read = ingest.TelemetryTable(spark, f"{folder}/out"), lambda rows: ingest.clean_telemetry(spark.read.schema(ingest.INCOMING_SCHEMA).json(spark.sparkContext.parallelize(rows)))
    table.append(read(lines_of(10, ["1", "1", None, None])), 0)
    assert table.events().count() == 3
    table.append(read(lines_of(10, ["9"])), 0)  # a replay, whatever it holds
    assert table.events().count() == 3
    # A try that died before its commit: its rows and ids are there, but do not count, and are overwritten.
    dead = read(lines_of(10, ["2", "3"]))
    table.commits.put, put = lambda *_: False, table.commits.put
    table.append(dead, 1)
    assert table.events().count() == 3 and spark.read.parquet(f"{folder}/out").count() == 5
    table.commits.put = put
    table.append(read(lines_of(10, ["1", "2", "3"])), 1)
    assert sorted(values(table.events().where("event_id IS NOT NULL"), "event_id")) == [("1",), ("2",), ("3",)]
    table.append(read(lines_of(10, ["1"], tenant_id="b")), 2)  # another tenant's event
    table.append(read([]), 3)
    assert table.events().count() == 6 and table.counts()[3]["newest"] == table.counts()[2]["newest"]
    table.append(read(lines_of(10, ["3"])), 4)
    assert table.events().count() == 6
    with pytest.raises(ValueError):
        table.append(read(lines_of(10, ["5"])), 5, stream="other")


def test_repeats_across_midnight_and_batches(spark, folder):
    table, read = ingest.TelemetryTable(spark, f"{folder}/out"), lambda rows: ingest.clean_telemetry(spark.read.schema(ingest.INCOMING_SCHEMA).json(spark.sparkContext.parallelize(rows)))
    event = lambda time, i: json.dumps({"event_id": i, "timestamp": time, "tenant_id": "a", "event_type": "ask"})
    table.append(read([event("2024-01-01T23:50:00Z", "x")]), 0)
    table.append(read([event("2024-01-02T00:10:00Z", "y")]), 1)
    table.append(read([event("2024-01-02T00:20:00Z", "x"), event("2024-01-01T23:55:00Z", "z")]), 2)
    assert sorted(values(table.events(True), "event_id", "late")) == [("x", False), ("y", False), ("z", False)]


def test_usage_counts_every_event_however_late(spark, folder):
    rows = spark.range(60).select(
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(10 * CAST(id / 20 AS INT))").alias("timestamp"), F.lit("t").alias("tenant_id"),
        F.lit("query").alias("event_type"), F.col("id").alias("rows_scanned"),
    )
    for part in ("day(timestamp) = 21", "day(timestamp) = 11", "day(timestamp) = 1"):  # the oldest come last
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        finish(usage_stream.write_all_usage(stream, f"{folder}/all", f"{folder}/cp1", compact_every=2))
    assert sorted(values(usage_stream.read_daily_usage(spark, f"{folder}/all"))) == sorted(values(usage.daily_usage(rows)))
    query = write_daily_usage(daily_usage_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/cp2")
    finish(query)
    assert usage_stream.dropped_rows(query) >= 1  # counted after the rows of a task are summed up


def test_a_snapshot_is_not_read_before_it_is_published(spark, folder):
    path, shape = f"{folder}/state", "key string, value double"
    frames = [spark.createDataFrame(rows, shape) for rows in ([("a", 1.0)], [("b", 2.0)], [("a", 3.0)])]
    for number, frame in enumerate(frames):
        live_metric.upsert_sink(path, ["key"], 0)(frame, number)
    read = lambda: sorted(values(live_metric.read_current(spark, path, ["key"], frames[0].schema)))
    frames[0].limit(1).write.parquet(f"{path}/_snapshots/upto=3")  # half of a snapshot, and half of a batch
    frames[1].write.parquet(f"{path}/batch=3")
    assert read() == [("a", 3.0), ("b", 2.0)]
    sink = live_metric.upsert_sink(path, ["key"], 2, keep=1)
    for number, value in ((3, 4.0), (4, 5.0), (5, 6.0)):
        sink(spark.createDataFrame([("c", value)], shape), number)
        sink(spark.createDataFrame([("c", -1.0)], shape), number)  # published batches are not written again
    assert read() == [("a", 3.0), ("b", 2.0), ("c", 6.0)]
    left = {p.name for p in pathlib.Path(path).glob("batch=*")} | {p.name for p in pathlib.Path(path).glob("_snapshots/upto=*")}
    assert left == {"upto=5"}


def test_snapshots_come_by_default(spark, folder):
    sink = live_metric.upsert_sink(f"{folder}/state")
    frame = spark.createDataFrame([("a", 1.0)], "key string, value double")
    for number in range(batches.COMPACT_EVERY):
        sink(frame, number)
    files = live_metric.read_current(spark, f"{folder}/state", ["key"], frame.schema).inputFiles()
    assert files and all(f"upto={batches.COMPACT_EVERY - 1}" in f for f in files)


def test_running_distinct_count(spark, folder):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 20_000).alias("v"))
    metric = MetricDefinition("m", "v", "nunique", "k")
    with pytest.raises(ValueError):
        live_metric.metric_stream(rows, metric)
    for part in range(5):
        rows.where(F.col("v") % 5 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        finish(live_metric.write_distinct(stream, metric, f"{folder}/out", f"{folder}/cp", compact_every=2))
    exact = dict(values(rows.groupBy("k").agg(F.countDistinct("v"))))
    found = dict(values(live_metric.read_distinct(spark, f"{folder}/out")))
    assert found.keys() == exact.keys() and all(abs(found[k] / exact[k] - 1) < 4 * 0.8 / 2 ** (live_metric.SKETCH_LOG2 / 2) for k in exact)
    total = MetricDefinition("m", "v", "nunique")
    sketches = live_metric.distinct_sketches(rows.where("v < 10"), total)
    assert sketches.select(F.hll_sketch_estimate("sketch")).first()[0] == 9

"""Streaming forms of the incremental load."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.registry import query
from rosterlens.session import scratch_path
from rosterlens.streaming import incremental

MID_MONTH = "TIMESTAMP_NTZ'2024-01-16 00:00:00'"


def landed(t, name):
    """Events written in two deliveries, before and after the middle of the month."""
    folder = scratch_path(t.spark, name)
    events = t.events
    return folder, events.where(f"ts < {MID_MONTH}"), events.where(f"ts >= {MID_MONTH}")


@query("t00_incremental_load_stream", "SELECT event_id, user_id, event_type FROM events")
def incremental_load(t):
    folder, first, second = landed(t, "landing")
    out, checkpoint = scratch_path(t.spark, "loaded"), scratch_path(t.spark, "loaded-state")
    for delivery in (first, second):
        delivery.write.mode("append").parquet(folder)
        stream = incremental.file_stream(t.spark, folder, t.events.schema).select("event_id", "user_id", "event_type")
        incremental.load_available(stream, out, checkpoint)
    return t.spark.read.parquet(out)


@query("t01_change_log_stream", """
WITH a AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, 'event_type' AS changed_column, a.event_type AS old_value, b.event_type AS new_value FROM a JOIN b USING (user_id) WHERE a.event_type <> b.event_type""")
def change_log_stream(t):
    """The newest event of every user is kept in the state store; each delivery logs what changed."""
    folder, first, second = landed(t, "feed")
    log, checkpoint = scratch_path(t.spark, "log"), scratch_path(t.spark, "feed-state")
    columns = ["user_id", "ts", "event_id", "event_type"]
    for delivery in (first, second):
        delivery.select(*columns).write.mode("append").parquet(folder)
        stream = incremental.file_stream(t.spark, folder, t.events.select(*columns).schema).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
        incremental.load_available(incremental.keyed_change_log(stream, "user_id", ["ts", "event_id"], ["event_type"]), log, checkpoint)
    return t.spark.read.schema("user_id bigint, changed_column string, old_value string, new_value string").parquet(log)


@query("t01_change_log_by_versions", """
WITH a AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, 'event_type' AS changed_column, a.event_type AS old_value, b.event_type AS new_value FROM a JOIN b USING (user_id) WHERE a.event_type <> b.event_type""")
def change_log_by_versions(t):
    """The same log with the state as published versions of a table that others can read."""
    folder, first, second = landed(t, "feed")
    root, log = scratch_path(t.spark, "state"), scratch_path(t.spark, "log")
    checkpoint = scratch_path(t.spark, "feed-state")
    columns = ["user_id", "ts", "event_id", "event_type"]
    handler = incremental.apply_changes(root, "user_id", ["ts", "event_id"], ["event_type"], log)
    for delivery in (first, second):
        delivery.select(*columns).write.mode("append").parquet(folder)
        stream = incremental.file_stream(t.spark, folder, t.events.select(*columns).schema)
        incremental.stream_changes(stream, handler, checkpoint)
    return t.spark.read.parquet(log).select("user_id", "changed_column", "old_value", "new_value")


@query("t02_windowed_counts_stream", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(t):
    folder, out = scratch_path(t.spark, "ticks"), scratch_path(t.spark, "windows")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type")
    rows.write.parquet(folder)
    incremental.end_of_input(rows, "ts").write.mode("append").parquet(folder)
    stream = incremental.file_stream(t.spark, folder, "ts timestamp, event_type string")
    counts = incremental.windowed_counts(stream, "ts", ["event_type"])
    flat = counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    incremental.load_available(flat, out, scratch_path(t.spark, "windows-state"))
    return t.spark.read.schema("day string, event_type string, n bigint").parquet(out)


@query("t02_counts_with_late_rows", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-11' AND event_id % 10 = 3) AS n_late FROM events GROUP BY 1, 2""")
def counts_with_late_rows(t):
    """Three deliveries; the last one brings, with its own, a tenth of the first one's rows, long behind the watermark."""
    folder, out, checkpoint = (scratch_path(t.spark, n) for n in ("ticks", "windows", "windows-state"))
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_id", "event_type")
    early, held_back = F.col("ts") < "2024-01-11", (F.col("ts") < "2024-01-11") & (F.col("event_id") % 10 == 3)
    handler = incremental.counts_with_late_rows(out, "ts", ["event_type"])
    for delivery in (rows.where(early & ~held_back), rows.where(~early & (F.col("ts") < "2024-01-21")), rows.where((F.col("ts") >= "2024-01-21") | held_back)):
        delivery.write.mode("append").parquet(folder)
        incremental.stream_changes(incremental.file_stream(t.spark, folder, rows.schema), handler, checkpoint)
    counts = incremental.read_counts(t.spark, out, ["event_type"])
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "n_late")

"""Queries that run a stream over what is there and read back its table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import intake
from .registry import query


def event_stream(t):
    schema = t.table("events").schema
    return intake.stream_of(t.spark, f"{t.sf_dir}/events*.parquet", schema)


@query("st1_intake_without_repeats", """
WITH RECURSIVE e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type,
                            row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS TIMESTAMP), event_id) AS n FROM events),
walk AS (
  SELECT *, TRUE AS kept, ts AS last FROM e WHERE n = 1
  UNION ALL
  SELECT e.*, e.ts - w.last >= INTERVAL 3 HOUR, CASE WHEN e.ts - w.last >= INTERVAL 3 HOUR THEN e.ts ELSE w.last END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.n = w.n + 1)
SELECT event_id, ts, user_id, event_type FROM walk WHERE kept""")
def _(t):
    """The batch rule drops a repeat within N days; here a user's event type within three hours."""
    stream = event_stream(t).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    folder = intake.work_folder(t.spark)
    kept = intake.without_repeats(stream, "ts", ["user_id", "event_type"], "3 hours")
    return intake.KeptTable(t.spark, folder, kept).run()


LATEST_SQL = """
SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def latest_events(t, compact_every):
    order = F.struct("ts", "event_id")
    table = intake.upsert_latest(event_stream(t), "user_id", order, intake.work_folder(t.spark), compact_every)
    return intake.latest_rows(t.spark, table, "user_id", order).select("user_id", "event_id", "event_type", "value")


@query("st2_latest_per_key", LATEST_SQL)
def _(t):
    return latest_events(t, 0)


@query("st2_latest_compacted", LATEST_SQL)
def _(t):
    """The same state from a snapshot that is merged after every batch."""
    return latest_events(t, 1)

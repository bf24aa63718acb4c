"""Streams over several files against the batch rule."""
import datetime
import random

import duckdb
from pyspark.sql import functions as F

from clubsieve.streaming import intake

SCHEMA = "event_id bigint, ts timestamp, user_id bigint"


def write_batches(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_latest_rows_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    write_batches(spark, source, [[(1, at(0), 1), (2, at(5), 2)], [(3, at(3), 2), (4, at(9), 1)], [(5, at(9), 1)]])
    stream = intake.stream_of(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    order = F.struct("ts", "event_id")
    table = intake.upsert_latest(stream, "user_id", order, str(tmp_path / "work"))
    assert len(spark.read.parquet(table).select("batch").distinct().collect()) == 3
    got = {r.user_id: r.event_id for r in intake.latest_rows(spark, table, "user_id", order).collect()}
    assert got == {1: 5, 2: 2}


def test_repeats_within_the_span_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    write_batches(spark, source, [[(1, at(0), 1), (2, at(10), 1), (3, at(20), 2)], [(4, at(40), 1), (5, at(500), 1)], [(6, at(505), 1), (7, at(560), 1)]])
    for files in (1, 10, 100):
        stream = intake.stream_of(spark, source, spark.read.parquet(source).schema, files_per_batch=files)
        out = intake.run_to_table(intake.without_repeats(stream, "ts", ["user_id"], "60 minutes"), str(tmp_path / f"work{files}"))
        assert {r.event_id for r in spark.read.parquet(out).collect()} == {1, 3, 5, 7}


def test_any_order_of_files_agrees_with_sql(spark, tmp_path):
    """Files in reverse order of time, keys hours apart, equal times and nulls, at several files a batch."""
    rng = random.Random(3)
    rows = [(i, at(rng.randrange(0, 1200)) if i % 20 else None, rng.choice((1, 1, 2, 3))) for i in range(150)]
    rows += [(200 + i, at(6000 + 20 * i), 4) for i in range(10)]
    rows.sort(key=lambda r: r[1] or at(0), reverse=True)
    source = str(tmp_path / "in")
    write_batches(spark, source, [rows[i:i + 14] for i in range(0, len(rows), 14)])
    con = duckdb.connect()
    con.execute("CREATE TABLE e0 (event_id BIGINT, ts TIMESTAMP, user_id BIGINT)")
    con.executemany("INSERT INTO e0 VALUES (?, ?, ?)", rows)
    want = {r[0] for r in con.execute("""
        WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e0 WHERE ts IS NOT NULL),
        walk AS (SELECT *, TRUE AS kept, ts AS last FROM e WHERE n = 1
          UNION ALL SELECT e.*, e.ts - w.last >= INTERVAL 1 HOUR, CASE WHEN e.ts - w.last >= INTERVAL 1 HOUR THEN e.ts ELSE w.last END
          FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
        SELECT event_id FROM walk WHERE kept""").fetchall()}
    for files in (1, 10, 100):
        stream = intake.stream_of(spark, source, spark.read.parquet(source).schema, files_per_batch=files)
        out = intake.run_to_table(intake.without_repeats(stream, "ts", ["user_id"], "60 minutes"), str(tmp_path / f"work{files}"))
        got = [r.event_id for r in spark.read.parquet(out).collect()]
        assert len(got) == len(want) and set(got) == want
        table = intake.KeptTable(spark, str(tmp_path / f"kept{files}"), intake.without_repeats(stream, "ts", ["user_id"], "60 minutes"))
        got = [r.event_id for r in table.run().collect()]
        assert len(got) == len(want) and set(got) == want


def test_a_hot_key_streams_through_the_walk(spark):
    """One key with nearly all rows is read in small Arrow batches; what was kept last is carried from one to the next."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = spark.createDataFrame([(i, at(7 * i), 1) for i in range(2000)] + [(5000, at(3), 2)], SCHEMA)
        got = sorted(r.event_id for r in intake.first_of_each_span(rows, "ts", ["user_id"], "60 minutes").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == [*range(0, 2000, 9), 5000]


def test_a_batch_costs_the_days_since_its_first_row(spark, tmp_path):
    """New rows walk their own day again; a reader in between sees whole tables; a batch run twice changes nothing."""
    source = str(tmp_path / "in")
    day = 24 * 60
    write_batches(spark, source, [[(d * 10 + i, at(d * day + 40 * i), 1) for i in range(8)] for d in range(4)])
    stream = intake.stream_of(spark, source, spark.read.parquet(source).schema)
    kept = intake.without_repeats(stream, "ts", ["user_id"], "60 minutes")
    table = intake.KeptTable(spark, str(tmp_path / "work"), kept)
    first = sorted(r.event_id for r in table.run().collect())
    assert first == [d * 10 + i for d in range(4) for i in (0, 2, 4, 6)]
    write_batches(spark, source, [[(90, at(3 * day + 400), 1), (91, at(3 * day + 410), 1)]])
    held = table.read()
    assert sorted(r.event_id for r in table.run().collect()) == [*first, 90]
    assert sorted(r.event_id for r in held.collect()) == first
    days = table._days()
    assert [days[d] for d in sorted(days)] == [0, 0, 0, 1]
    write_batches(spark, source, [[(95, at(2 * day - 20), 1)]])  # late: the day before it ends, and all that follows
    late = sorted(r.event_id for r in table.run().collect())
    assert late == sorted([0, 2, 4, 6, 10, 12, 14, 16, 95, 21, 23, 25, 27, 30, 32, 34, 36, 90])
    assert table.run().count() == len(late) and [table._days()[d] for d in sorted(days)] == [0, 2, 2, 2]
    table.write(spark.createDataFrame([(95, at(2 * day - 20), 1)], SCHEMA), 2)
    assert sorted(r.event_id for r in table.read().collect()) == late


def test_compaction_reads_the_snapshot_and_later_batches_only(spark, tmp_path):
    rng = random.Random(8)
    source, order = str(tmp_path / "in"), F.struct("ts", "event_id")
    rows = [(i, at(rng.randrange(0, 900)), rng.choice((None, 1, 1, 1, 2, 3, 4, 5, 6))) for i in range(140)]
    write_batches(spark, source, [rows[i:i + 20] for i in range(0, len(rows), 20)])
    stream = intake.stream_of(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    plain = intake.upsert_latest(stream, "user_id", order, str(tmp_path / "plain"))
    table = intake.upsert_latest(stream, "user_id", order, str(tmp_path / "work"), compact_every=3)
    state = lambda path: {r.user_id: r.event_id for r in intake.latest_rows(spark, path, "user_id", order).collect()}
    want = {}
    for i, ts, user in sorted(rows, key=lambda r: (r[1], r[0])):
        want[user] = i
    assert state(plain) == state(table) == want
    assert intake.compacted_upto(spark, plain) == -1 and intake.compacted_upto(spark, table) == 5
    scan = intake._snapshot_and_later(spark, table)
    read = {r[0] for r in scan.select(F.input_file_name()).collect()}
    assert read and all("snapshots/upto=5" in f or "batch=6" in f for f in read)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "(batch#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]  # earlier batches are pruned, not filtered


def test_a_compaction_cut_short_changes_nothing(spark, tmp_path):
    source, order = str(tmp_path / "in"), F.struct("ts", "event_id")
    write_batches(spark, source, [[(1, at(0), 1), (2, at(1), 2)], [(3, at(2), 1)], [(4, at(3), 3)]])
    stream = intake.stream_of(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    table = intake.upsert_latest(stream, "user_id", order, str(tmp_path / "work"))
    state = lambda: {r.user_id: r.event_id for r in intake.latest_rows(spark, table, "user_id", order).collect()}
    before = state()
    spark.createDataFrame([(99, at(99), 1)], SCHEMA).write.parquet(f"{table}-snapshots/upto=1")  # written, never named
    assert state() == before and intake.compacted_upto(spark, table) == -1
    for upto in (1, 2, 0):  # an earlier one after a later one does nothing
        intake.compact(spark, table, "user_id", order, upto)
        assert state() == before
    assert intake.compacted_upto(spark, table) == 2

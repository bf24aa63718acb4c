"""Streaming forms of two batch rules: intake without repeats, and the latest state per key."""
from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import shared_folder


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, for a stream's output and progress."""
    return os.path.join(shared_folder(spark), f"stream-{uuid.uuid4()}")


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@dataclass(frozen=True)
class Intake:
    """A stream whose rows are walked per key in order of time, once all that is there has arrived."""
    stream: DataFrame
    time: str
    keys: tuple[str, ...]
    within: str


def without_repeats(stream: DataFrame, time: str, keys: list[str], within: str) -> Intake:
    """The rows of each key that come at least a span of time after the last one kept; rows without a time are left out.

    Which rows stay depends on all earlier ones of the key, whatever the order of their arrival, so the stream only
    appends rows and run_to_table walks the table: no row is late, and it does not matter how files fall into batches.
    """
    return Intake(stream, time, tuple(keys), within)


def first_of_each_span(rows: DataFrame, time: str, keys: list[str] | tuple[str, ...], within: str, kept_before: DataFrame | None = None) -> DataFrame:
    """The batch rule of without_repeats. Of rows of one time the least counts, by the other columns in order, nulls last.

    Rows of one key and time fold in Spark; the rest stream through the walk sorted, in Arrow batches, and the
    walk remembers the key and the time last kept. `kept_before` are rows kept earlier, all before these: the walk of
    a key goes on after its last one.
    """
    span, columns = pd.Timedelta(within).value // 1000, rows.columns
    at = [columns.index(k) for k in keys]
    order = [part for c in columns if c not in (*keys, time) for part in (F.col(c).isNull().alias(f"no {c}"), F.col(c))]
    one = rows.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.min(F.struct(F.lit(0).alias("none of them"), *order)).alias("least of them"))
    sorted_rows = one.select(*[F.col(c) if c in (*keys, time) else F.col(f"least of them.`{c}`") for c in columns],
                             F.unix_micros(F.col(time).cast("timestamp")).alias("micros of it"), F.lit(False).alias("kept before"))
    if kept_before is not None:
        last = kept_before.groupBy(*keys).agg(F.max(time).alias(time))
        sorted_rows = sorted_rows.unionByName(last.select(*keys, time, F.unix_micros(F.col(time).cast("timestamp")).alias("micros of it"), F.lit(True).alias("kept before")), allowMissingColumns=True)
    sorted_rows = sorted_rows.repartition(*keys).sortWithinPartitions(*keys, time)

    def walk(batches):
        current, last = None, 0
        for b in batches:
            kept = []
            for *key, t, before in zip(*[b.column(i).to_pylist() for i in at], b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist()):
                take = before or key != current or t - last >= span
                kept.append(take and not before)
                if take:
                    current, last = key, t
            yield pa.RecordBatch.from_arrays(b.columns[:-2], names=columns).filter(pa.array(kept, pa.bool_()))

    return sorted_rows.mapInArrow(walk, rows.schema)


def run_to_table(stream: DataFrame | Intake, folder: str) -> str:
    """Runs a stream over all that is there and returns the path of the table it wrote.

    Rows of an Intake are appended to a table of their own; what is kept of all of them replaces the table.
    """
    out = f"{folder}/table"
    rows = stream.stream if isinstance(stream, Intake) else stream
    path = f"{folder}/rows" if isinstance(stream, Intake) else out
    q = (rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{folder}/progress")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if isinstance(stream, Intake):
        arrived = rows.sparkSession.read.schema(rows.schema).parquet(path)
        first_of_each_span(arrived, stream.time, stream.keys, stream.within).write.mode("overwrite").parquet(out)
    return out


class KeptTable:
    """The rows of an Intake that stay, kept up to date batch by batch below one folder.

    * `rows/batch=N/day=D` holds what has arrived, `kept/batch=N/day=D` what stays of a day as batch N left it.
    * A batch walks its earliest day and the later ones again, from the rows kept in the span before; a late row thus
      costs the days since. Days before it are not read.
    * `days/batch=N` says which batch has the valid rows of each day. It is one small file and is written last, so a
      reader sees the table before the batch or after it, and a batch that is run again replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, folder: str, intake: Intake):
        self.spark, self.folder, self.intake = spark, folder, intake
        self.schema = intake.stream.schema
        self.parts = T.StructType([*self.schema.fields, T.StructField("_batch", T.IntegerType()), T.StructField("_day", T.DateType())])

    def _days(self, before: int | None = None) -> dict:
        """Day to batch, as of the last batch, or the last one before a number."""
        try:
            named = self.spark.read.schema("day date, valid int, _batch int").parquet(f"{self.folder}/days")
        except AnalysisException:  # no batch yet
            return {}
        if before is not None:
            named = named.where(F.col("_batch") < before)
        last = named.agg(F.max("_batch").alias("n")).first().n
        return {} if last is None else {r.day: r.valid for r in named.where(F.col("_batch") == last).collect()}

    def _kept(self, days: dict) -> DataFrame:
        paths = [f"{self.folder}/kept/_batch={n}/_day={day}" for day, n in days.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, batch: DataFrame, number: int) -> None:
        time = self.intake.time
        dated = batch.where(F.col(time).isNotNull()).withColumn("_day", F.to_date(time))
        dated.write.mode("overwrite").partitionBy("_day").parquet(f"{self.folder}/rows/_batch={number}")
        arrived = self.spark.read.schema(self.parts).parquet(f"{self.folder}/rows")
        begin = arrived.where(F.col("_batch") == number).agg(F.min("_day").alias("d")).first().d
        if begin is None:
            return
        days = self._days(number)
        reach = begin - timedelta(days=pd.Timedelta(self.intake.within).days + 1)
        seeds = self._kept({d: n for d, n in days.items() if reach <= d < begin})
        fresh = arrived.where((F.col("_day") >= F.lit(begin)) & (F.col("_batch") <= number)).drop("_batch", "_day")
        found = first_of_each_span(fresh, time, self.intake.keys, self.intake.within, seeds).withColumn("_day", F.to_date(time))
        found.write.mode("overwrite").partitionBy("_day").parquet(f"{self.folder}/kept/_batch={number}")
        written = self.spark.read.schema(self.parts).parquet(f"{self.folder}/kept").where(F.col("_batch") == number).select("_day").distinct().collect()
        valid = [(d, n) for d, n in days.items() if d < begin] + [(r["_day"], number) for r in written]
        self.spark.createDataFrame(valid, "day date, valid int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/days/_batch={number}")

    def run(self) -> DataFrame:
        """Takes in all that is there and returns the table."""
        q = (self.intake.stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.folder}/progress")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return self.read()

    def read(self) -> DataFrame:
        return self._kept(self._days())


def newest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, order).alias("r")).select("r.*")


def upsert_latest(stream: DataFrame, key: str, order: Column, folder: str, compact_every: int = 0) -> str:
    """Appends each batch's newest row per key to a table and returns its path.

    A batch writes its own partition only, so the cost follows the batch and not the table, and
    a repeated batch replaces what it wrote. latest_rows gives the current state. With compact_every, batches
    are merged into a snapshot after each so many, between two batches.
    """
    out = f"{folder}/table"

    def write(batch: DataFrame, number: int) -> None:
        newest(batch, key, order).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if compact_every and (number + 1) % compact_every == 0:
            compact(batch.sparkSession, out, key, order, number)

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def compacted_upto(spark: SparkSession, table: str) -> int:
    """The last batch that the current snapshot holds, -1 without one."""
    try:
        named = spark.read.schema("upto int").parquet(f"{table}-current")
    except AnalysisException:  # never compacted
        return -1
    last = named.agg(F.max("upto").alias("n")).first().n
    return -1 if last is None else last


def _snapshot_and_later(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """The rows of the current snapshot and of the batches after it; no batch that it holds is read."""
    done = compacted_upto(spark, table)
    batches = spark.read.parquet(table).where(F.col("batch") > done)
    later = (batches if upto is None else batches.where(F.col("batch") <= upto)).drop("batch")
    return later if done < 0 else later.unionByName(spark.read.schema(later.schema).parquet(f"{table}-snapshots/upto={done}"))


def compact(spark: SparkSession, table: str, key: str, order: Column, upto: int) -> None:
    """Merges the snapshot and the batches up to a complete one into a new snapshot, in ranges of the key.

    The snapshot gets a folder of its own. A small file that names it is written last and makes it current, so one
    that was cut short is never read and the next run replaces it. A batch that the current snapshot holds is not
    compacted again, so no reader's files are replaced. Older snapshots and batches are left for readers that
    began before; they may be removed once those have ended.
    """
    if upto <= compacted_upto(spark, table):
        return
    merged = newest(_snapshot_and_later(spark, table, upto), key, order)
    merged.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{table}-snapshots/upto={upto}")
    spark.createDataFrame([(upto,)], "upto int").coalesce(1).write.mode("append").parquet(f"{table}-current")


def latest_rows(spark: SparkSession, table: str, key: str, order: Column) -> DataFrame:
    """The newest row per key: the current snapshot and the batches since."""
    return newest(_snapshot_and_later(spark, table), key, order)

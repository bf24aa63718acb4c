"""Latest rows, survivors and top-n lists.

"The best n rows of a group" is row_number() <= n, which Spark turns into a per-task group limit
ahead of the shuffle: a group that holds a third of the table sends n rows per task. Orders end
in an ascending id, so ids may be numbers or text.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import settle


def best_row(df: DataFrame, keys, order: list) -> DataFrame:
    """The whole first row of each group by a list of sort columns."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    first = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return first.filter(F.col("_rank") <= 1).drop("_rank")


def latest_checks(checks: DataFrame) -> DataFrame:
    """Newest check of each listing; the smaller id wins a tie."""
    return best_row(checks.filter(F.col("league_id").isNotNull()), "league_id", [F.desc("checked_at"), "check_id"])


def latest_snapshots(snapshots: DataFrame, by: str = "domain") -> DataFrame:
    return best_row(snapshots, by, [F.desc("created_at"), "snapshot_id"])


def first_by_key(df: DataFrame, key: str, arrival: str) -> DataFrame:
    return best_row(df, key, [F.asc_nulls_last(arrival)])


def top_n(df: DataFrame, keys, order: list, n: int | None, rank_as: str | None = None) -> DataFrame:
    """The first n rows of each group; None means all of them."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked if n is None else ranked.filter(F.col("_rank") <= n)
    return kept.withColumnRenamed("_rank", rank_as) if rank_as else kept.drop("_rank")


def best_links(links: DataFrame, per_page: int | None = 20) -> DataFrame:
    """One row per target of a page, with its highest score, then the best targets of the page."""
    once = best_row(links, ["page_id", "discovered_url"], [F.desc("score"), "position"])
    return top_n(once, "page_id", [F.desc("score"), "position"], per_page, "link_rank")


def top_with_overflow(df: DataFrame, keys, order: list, n: int) -> DataFrame:
    """The first n rows of each group and how many more the group has."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    sizes = df.groupBy(*keys).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("overflow"))
    return top_n(df, keys, order, n, "rank").join(sizes, keys)


def rank_within(df: DataFrame, key: str, order: list, bucket: Column, rank_as: str) -> DataFrame:
    """Exact row numbers in each group without sorting a whole group in one task.

    `bucket` must not decrease along the order (a day of a timestamp, say). Rows are numbered
    inside (key, bucket); the offset of a bucket is the count of all earlier ones, from a table
    with one row per key and bucket.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (b.withColumn("_local", F.row_number().over(inside)).join(offsets, [key, "_bucket"])
            .withColumn(rank_as, (F.col("_offset") + F.col("_local")).cast("int"))
            .drop("_bucket", "_local", "_offset"))


def survivors(df: DataFrame, keys) -> DataFrame:
    """The record with the highest quality of each group; the smaller id wins a tie."""
    return best_row(df, keys, [F.desc(F.coalesce("quality_score", F.lit(0))), "league_id"])


def placed(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """All rows in one order with their place in it, from 0.

    Rows are cut into ranges of the order, whose bounds Spark samples; a row's place is its place in its range plus
    the rows of the ranges before. The ranges are settled, so that a lost executor cannot cut them otherwise; the
    driver gets one number per range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_at", T.LongType())])

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=schema.names)
            at += n

    rows = settle(ranges.mapInArrow(number, schema))
    before, total = [], 0
    for r in sorted(rows.groupBy("_range").count().collect()):
        before.append((r["_range"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(before, "_range int, _before bigint")
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def rank_in_groups(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """row_number() per group, where a group may hold any share of the rows: it is spread over many ranges.

    A group is a stretch of the order by keys and `order`, so the rank is the distance from its first place. Null keys
    make a group like any other. Rows that are equal in the order are ranked in no particular one.
    """
    rows = placed(df, [*[F.col(k).asc_nulls_first() for k in keys], *order], "_place")
    first = rows.groupBy(*keys).agg(F.min("_place").alias("_first")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(first, same).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first", *[f"_k{i}" for i in range(len(keys))])

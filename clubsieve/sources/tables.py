"""Reading and writing of plain tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The wanted columns of a Parquet table; the reader never touches the others."""
    return spark.read.parquet(path).select(*columns)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed column order with a header; columns outside the list are ignored, missing ones are empty."""
    kept = [F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    df.select(*kept).write.mode("error").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append rows to a table in the shared store."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def snapshot_rows(pages: DataFrame, fetched_at: Column, snapshot_type: str = "playwright_yaml",
                  content_format: str = "yaml") -> DataFrame:
    """Snapshot rows ready to append: domain, size, token estimate, metadata and pending status.

    Partition them by day, not by domain: a table of domains has too many of them and one may be
    huge, while a day stays a few large files.
    """
    n = F.length("content")
    return pages.select(
        "url", "content", urls.base_domain(F.col("url")).alias("domain"), F.lit(snapshot_type).alias("snapshot_type"),
        F.lit(content_format).alias("content_format"), F.octet_length("content").alias("size_bytes"),
        F.floor(n / 4).cast("int").alias("token_estimate"),
        F.create_map(F.lit("fetch_time"), fetched_at.cast("string")).alias("metadata"),
        F.lit("pending").alias("extraction_status"), fetched_at.alias("created_at"), F.to_date(fetched_at).alias("fetch_day"))


def snapshots_of(df: DataFrame, domain: str | None = None, url: str | None = None) -> DataFrame:
    """Snapshots of a domain or a URL, newest first."""
    if domain is not None:
        df = df.filter(F.col("domain") == domain)
    if url is not None:
        df = df.filter(F.col("url") == url)
    return df.orderBy(F.desc("created_at"), "snapshot_id")


def link_rows(links: DataFrame) -> DataFrame:
    """Discovered links ready to append, with the base domain of their source."""
    return links.withColumn("base_domain", urls.base_domain(F.col("source_url")))


CHECK_COLUMNS = ("check_id", "check_run_id", "league_id", "old_num_teams", "new_num_teams", "division_name", "nav_path",
                 "screenshot_paths", "status", "raw_teams", "url_checked", "notes")


def check_rows(checks: DataFrame) -> DataFrame:
    """Check rows ready to append: known columns only."""
    return checks.select(*[c for c in CHECK_COLUMNS if c in checks.columns])


def review_rows(listings: DataFrame, existing_id: Column, reason: Column) -> DataFrame:
    """Review-queue rows that hold the whole extracted record as JSON."""
    return listings.select(F.col("url_scraped").alias("url"), F.to_json(F.struct(*listings.columns)).alias("extracted"),
                           existing_id.alias("existing_league_id"), reason.alias("reason"), F.lit("PENDING").alias("status"))


def detail_rows(links: DataFrame, queue: DataFrame) -> DataFrame:
    """Deferred detail pages with the queue id of their parent (least id of the URL)."""
    ids = queue.groupBy(F.col("url").alias("parent_url")).agg(F.min("scrape_id").alias("scrape_id"))
    return links.join(ids, "parent_url", "left").withColumn("status", F.lit("PENDING"))


def domain_audit(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose stored domain is not the base domain, counted per table in one union."""
    parts = [df.select(F.lit(name).alias("table_name"), (F.col(c) != urls.base_domain(F.col(c))).alias("bad"))
             for name, (df, c) in tables.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("table_name").agg(F.count("*").alias("row_count"), F.count_if("bad").alias("not_normalized"))

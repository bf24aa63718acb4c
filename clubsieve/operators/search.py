"""Search results: screening, queries to run, and what goes into the work queue."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys, screening, urls
from .ranking import best_row


def screen_results(results: DataFrame) -> DataFrame:
    """Results with reason, validity, organisation, priority (valid ones) and canonical URL.

    Every step is a column of its own, so the text and the reason are computed once per row.
    """
    url = F.col("url_raw")
    return (results
            .withColumn("content", screening.content_of(F.col("page_title"), F.col("page_snippet")))
            .withColumn("validation_reason", screening.validation_reason(url, F.col("content")))
            .withColumns({"is_valid": F.col("validation_reason").startswith("valid_"),
                          "organization_name": F.nullif(urls.org_name(url, F.col("page_title")), F.lit("")),
                          "url_canonical": urls.canonicalize_url(url)})
            .withColumns({"validation_status": F.when(F.col("is_valid"), "PASSED").otherwise("FAILED"),
                          "priority": F.when(F.col("is_valid"), screening.priority(
                              url, F.col("content"), F.col("search_rank"), F.col("organization_name"),
                              F.col("validation_reason")))}))


def query_grid(cities: DataFrame, sports: list[str], seasons: list[str] | None = None,
               country: str | None = None, state: str | None = None, year: int | None = None) -> DataFrame:
    """Every city with every sport and season, as search text and fingerprint.

    Sports and seasons are short lists of the caller, so each city row explodes them in place:
    no join at all.
    """
    text = lambda v: F.lit(v).cast("string")
    grid = (cities.select("city", F.explode(F.array(*[F.lit(s) for s in sports])).alias("sport"))
            .withColumn("season", F.explode(F.array(*[text(s) for s in (seasons or [None])]))))
    city, sport, season = F.col("city"), F.col("sport"), F.col("season")
    return grid.withColumns({
        "query_text": keys.search_text(city, sport, season), "country": text(country),
        "query_fingerprint": keys.fingerprint(city, text(state), text(country), sport, season,
                                              F.lit(year).cast("int"))})


def mark_recent(grid: DataFrame, past: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Flags queries whose fingerprint ran within the last days."""
    recent = past.filter(F.col("search_date") >= F.date_sub(as_of, days)).select(
        "query_fingerprint").distinct().withColumn("is_duplicate", F.lit(True))
    return grid.join(recent, "query_fingerprint", "left").withColumn(
        "is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def new_queries(grid: DataFrame, past: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The queries that did not run within the last days."""
    recent = past.filter(F.col("search_date") >= F.date_sub(as_of, days)).select("query_fingerprint")
    return grid.join(recent, "query_fingerprint", "left_anti")


def queue_plan(results: DataFrame, queue: DataFrame, listings: DataFrame) -> DataFrame:
    """What happens to each valid result: ADDED, or skipped as queued, scraped or repeated.

    Lookups are distinct URL lists with a flag; the first result of a URL (least id) is added.
    """
    valid = results.filter(F.col("priority").isNotNull())
    active = queue.filter(F.col("status").isin("PENDING", "IN_PROGRESS")).select(
        F.col("url").alias("url_canonical")).distinct().withColumn("queued", F.lit(True))
    scraped = listings.select(F.col("url_scraped").alias("url_canonical")).distinct().withColumn("scraped", F.lit(True))
    first = valid.groupBy("url_canonical").agg(F.min("result_id").alias("first_id"))
    action = (F.when(F.col("queued"), "SKIPPED_QUEUED").when(F.col("scraped"), "SKIPPED_SCRAPED")
              .when(F.col("result_id") != F.col("first_id"), "SKIPPED_REPEATED").otherwise("ADDED"))
    return (valid.join(active, "url_canonical", "left").join(scraped, "url_canonical", "left")
            .join(first, "url_canonical").withColumn("action", action))


def queue_additions(results: DataFrame, queue: DataFrame, listings: DataFrame) -> DataFrame:
    """New queue rows from the valid results: anti joins, then one row per URL."""
    url = F.col("url_canonical")
    valid = results.filter(F.col("is_valid")).select("result_id", "url_canonical", "organization_name", "priority")
    active = queue.filter(F.col("status").isin("PENDING", "IN_PROGRESS")).select(F.col("url").alias("url_canonical"))
    scraped = listings.select(F.col("url_scraped").alias("url_canonical"))
    new = valid.join(active, "url_canonical", "left_anti").join(scraped, "url_canonical", "left_anti")
    return best_row(new, "url_canonical", ["result_id"]).select(
        url.alias("url"), urls.base_domain(url).alias("base_domain"), F.col("result_id").alias("source_result_id"),
        "organization_name", "priority", F.lit("PENDING").alias("status"), F.lit(0).alias("scrape_attempts"))

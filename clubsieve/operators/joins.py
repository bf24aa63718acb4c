"""Lookups between listings, searches, checks, venues and snapshots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..functions.codes import seasons_table, sports_table
from .ranking import best_row
from .reports import domain_city_map


def backfill_city_from_search(listings: DataFrame, queue: DataFrame, results: DataFrame,
                              queries: DataFrame) -> DataFrame:
    """City of the search that led to a listing's URL; the least city where several did."""
    per_url = (queue.select("url", F.col("source_result_id").alias("result_id"))
               .join(results.select("result_id", "query_id"), "result_id")
               .join(queries.select("query_id", F.col("city").alias("found_city")), "query_id")
               .groupBy(F.col("url").alias("url_scraped")).agg(F.min("found_city").alias("found_city")))
    return listings.join(per_url, "url_scraped", "left").withColumn(
        "city", F.coalesce("city", "found_city")).drop("found_city")


def urls_with_check_age(listings: DataFrame, checks: DataFrame) -> DataFrame:
    """Per URL and organisation: listings, last check and whether any check saw a change."""
    per_listing = checks.groupBy("league_id").agg(
        F.max("checked_at").alias("last"), F.bool_or(F.col("status") == "CHANGED").alias("changed"))
    return (listings.filter(~F.col("is_archived")).join(per_listing, "league_id", "left")
            .groupBy("url_scraped", F.col("organization_name").alias("org_name"))
            .agg(F.count("*").alias("league_count"), F.max("last").alias("last_checked_at"),
                 F.bool_or("changed").alias("has_changes"))
            .orderBy(F.asc_nulls_first("last_checked_at"), "url_scraped"))


def venues_in_season(venues: DataFrame, listings: DataFrame, season: str) -> DataFrame:
    linked = listings.filter(F.col("season_name").ilike(f"%{season}%")).select("venue_id")
    return venues.join(linked, "venue_id", "left_semi")


def city_with_fallback(listings: DataFrame, results: DataFrame, queries: DataFrame) -> DataFrame:
    """City from the URL path, else from the only city searched for the domain; with the pass used."""
    by_domain = domain_city_map(results, queries, urls.base_domain(F.col("url_canonical"))).withColumnRenamed(
        "city", "domain_city")
    out = (listings.withColumn("path_city", urls.city_from_url(F.col("url_scraped")))
           .withColumn("domain", urls.base_domain(F.col("url_scraped"))).join(by_domain, "domain", "left"))
    return out.withColumns({
        "city": F.coalesce("path_city", "domain_city"),
        "city_source": F.when(F.col("path_city").isNotNull(), "url_path").when(
            F.col("domain_city").isNotNull(), "search").otherwise("none")}).drop("path_city", "domain_city", "domain")


def link_venues(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """Venue ids set on listings by exact venue name (least id per name), others kept."""
    ids = venues.groupBy("venue_name").agg(F.min("venue_id").alias("_venue_id"))
    current = F.col("venue_id") if "venue_id" in listings.columns else F.lit(None).cast("bigint")
    return listings.join(ids, "venue_name", "left").withColumn(
        "venue_id", F.coalesce("_venue_id", current)).drop("_venue_id")


def fill_counts(listings: DataFrame, counts: DataFrame) -> DataFrame:
    """A second-pass team count, written only where the listing has none (null or zero)."""
    found = counts.filter(F.col("found_teams") != 0).groupBy("league_id").agg(F.min("found_teams").alias("found_teams"))
    return listings.join(found, "league_id", "left").withColumn(
        "num_teams", F.coalesce(F.nullif(F.col("num_teams"), F.lit(0)), F.col("found_teams"), F.col("num_teams"))).drop("found_teams")


def backfill_city(listings: DataFrame, results: DataFrame, queries: DataFrame) -> DataFrame:
    """(league_id, city, city_source) of the listings without a city that get one; others are left out."""
    lacking = listings.filter("city IS NULL AND url_scraped IS NOT NULL")
    return city_with_fallback(lacking, results, queries).filter("city IS NOT NULL").select("league_id", "city", "city_source")


def code_names(listings: DataFrame) -> DataFrame:
    """Season and sport names of the codes, from the two fixed dictionaries."""
    spark = listings.sparkSession
    sound = F.length("sport_season_code") == 3
    coded = listings.withColumns({"season_code": F.when(sound, F.substring("sport_season_code", 1, 1)),
                                  "sport_code": F.when(sound, F.substring("sport_season_code", 2, 2))})
    return coded.join(F.broadcast(seasons_table(spark)), "season_code", "left").join(
        F.broadcast(sports_table(spark)), "sport_code", "left")


def fresh_snapshots(snapshots: DataFrame, as_of: Column, key: str = "url", days: int = 7) -> DataFrame:
    """The newest snapshot per key at a day, if it is not older than `days`."""
    recent = snapshots.filter((F.col("created_at") <= as_of) & (F.col("created_at") >= F.date_sub(as_of, days)))
    return best_row(recent, key, [F.desc("created_at"), "snapshot_id"])


def fresh_batches(snapshots: DataFrame, as_of: Column, marker: str, days: int = 7, min_chars: int = 1000) -> DataFrame:
    """The whole newest sound batch of each site.

    The age is tested on the newest page of the site; only then stubs go: short pages, and pages
    without the marker unless they are summaries.
    """
    fresh = snapshots.groupBy("site").agg(F.max("batch").alias("_newest")).filter(
        F.col("_newest") >= F.date_sub(as_of, days)).drop("_newest")
    sound = snapshots.filter((F.length("content") >= min_chars) & (
        F.col("is_summary") | F.col("content").contains(marker))).join(fresh, "site", "left_semi")
    newest = sound.groupBy("site").agg(F.max("batch").alias("batch"))
    return sound.join(newest, ["site", "batch"], "left_semi")

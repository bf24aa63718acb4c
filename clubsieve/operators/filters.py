"""Filters, pages and lists over listings, the work queue, venues, links and checks.

Every filter is a plain predicate on stored columns, so it reaches the Parquet scan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv


def contains_ci(column: str, text: str):
    """Case-insensitive substring test, with the pattern characters of the text kept literal."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{safe}%")


def active_listings(df: DataFrame, listing_types=("league",), org_search=None, sport_names=None,
                    sport_season_codes=None, days=None, genders=None, levels=None, domains=None,
                    quality_min=None, quality_max=None) -> DataFrame:
    """Active listings under all given filters, lowest quality first."""
    out = df.filter(F.col("listing_type").isin(*listing_types) & ~F.col("is_archived"))
    if org_search:
        out = out.filter(contains_ci("organization_name", org_search))
    for column, values in (("sport_name", sport_names), ("sport_season_code", sport_season_codes),
                           ("day_of_week", days), ("gender_eligibility", genders),
                           ("standardized_comp_level", levels), ("base_domain", domains)):
        if values:
            out = out.filter(F.col(column).isin(*values))
    if quality_min is not None:
        out = out.filter(F.col("quality_score") >= quality_min)
    if quality_max is not None:
        out = out.filter(F.col("quality_score") <= quality_max)
    return out.orderBy("quality_score", "league_id")


def queue_filter(df: DataFrame, statuses=None, priorities=None, search=None) -> DataFrame:
    """Queue rows by status, priority and a text found in the URL or the organisation."""
    if statuses:
        df = df.filter(F.col("status").isin(*statuses))
    if priorities:
        df = df.filter(F.col("priority").isin(*priorities))
    if search:
        safe = search.replace("%", "").replace("'", "")
        df = df.filter(F.col("url").ilike(f"%{safe}%") | F.col("organization_name").ilike(f"%{safe}%"))
    return df


def queue_page(df: DataFrame, offset: int = 0, limit: int = 50, **filters) -> DataFrame:
    """One page in order of priority and age; the id makes the order total."""
    return (queue_filter(df, **filters).orderBy("priority", "created_at", "scrape_id")
            .offset(offset).limit(limit))


def queue_row_count(df: DataFrame, page_size: int = 50, **filters) -> DataFrame:
    n = F.count("*")
    return queue_filter(df, **filters).agg(n.alias("row_count"),
                                           F.ceil(n / page_size).alias("page_count"))


def claim_next(df: DataFrame, limit: int = 1) -> DataFrame:
    """The next pending rows by priority and age; 0 takes all."""
    ordered = df.filter(F.col("status") == "PENDING").orderBy("priority", "created_at", "scrape_id")
    return ordered.limit(limit) if limit else ordered


def venues_to_review(df: DataFrame, limit: int = 50) -> DataFrame:
    return (df.filter(~F.col("manually_verified") & (F.col("confidence_score") < fv.VENUE_SAVE_FROM))
            .orderBy("confidence_score", "venue_id").limit(limit))


def venues_to_classify(df: DataFrame) -> DataFrame:
    return df.filter(F.col("lat").isNotNull() & F.col("court_type_broad").isNull())


def enriched_venues(venues: DataFrame, listings: DataFrame | None = None, broad=None, specific=None,
                    province=None, city=None, sport=None, season=None) -> DataFrame:
    """Located venues under optional filters; the season is tested on the linked listings."""
    out = venues.filter(F.col("lat").isNotNull())
    for column, value in (("court_type_broad", broad), ("court_type_specific", specific),
                          ("province", province)):
        if value:
            out = out.filter(F.col(column) == value)
    if city:
        out = out.filter(contains_ci("city", city))
    if sport:
        out = out.filter(F.array_contains("sports", sport))
    if season:
        linked = listings.filter(contains_ci("season_name", season)).select("venue_id")
        out = out.join(linked, "venue_id", "left_semi")
    return out.orderBy("city", "venue_name", "venue_id")


def venue_list(df: DataFrame) -> DataFrame:
    return df.orderBy("city", "venue_name", "venue_id")


def listings_of_venue(listings: DataFrame, venue_id=None, venue_name=None) -> DataFrame:
    """Listings of one venue, by id or by name in any case, ordered by day."""
    test = F.col("venue_id") == venue_id if venue_id is not None else (
        F.lower("venue_name") == venue_name.lower())
    return listings.filter(test).orderBy("day_of_week", "league_id")


def links_of(df: DataFrame, source_url: str | None = None, min_score: int | None = None,
             page_type: str | None = None) -> DataFrame:
    """Links by score, optionally of one source, above a score, or of one type."""
    if source_url is not None:
        df = df.filter(F.col("source_url") == source_url)
    if min_score is not None:
        df = df.filter(F.col("score") >= min_score)
    if page_type is not None:
        df = df.filter(F.col("page_type") == page_type)
    return df.orderBy(F.desc("score"), "source_url", "position")


def unprocessed_links(df: DataFrame, limit: int = 10, source_url: str | None = None) -> DataFrame:
    out = df.filter(F.col("status").isNull() | (F.col("status") == "pending"))
    if source_url is not None:
        out = out.filter(F.col("source_url") == source_url)
    return out.orderBy(F.desc("score"), "source_url", "position").limit(limit)


def low_quality(df: DataFrame, below: int = 50) -> DataFrame:
    return df.filter(F.coalesce("quality_score", F.lit(0)) < below)


WORK_LIST_ORDERS = {
    "quality_high": (F.desc, "avg_quality"), "quality_low": (F.asc, "avg_quality"),
    "missing_most": (F.desc, "avg_missing"), "count_most": (F.desc, "league_count"),
}


def filter_work_list(df: DataFrame, search=None, low=0, high=100, order="quality_low") -> DataFrame:
    """The per-URL work list by text in three columns, quality range and one of four orders."""
    if search:
        df = df.filter(contains_ci("org_name", search) | contains_ci("base_domain", search)
                       | contains_ci("url", search))
    way, column = WORK_LIST_ORDERS[order]
    return df.filter(F.col("avg_quality").between(low, high)).orderBy(way(column), "url")


def listings_of_site(df: DataFrame, org: str | None = None, host: str | None = None) -> DataFrame:
    if org:
        df = df.filter(contains_ci("organization_name", org))
    if host:
        df = df.filter(contains_ci("url_scraped", host))
    return df


def missing_fields(df: DataFrame, fields=fv.ENRICHABLE_FIELDS):
    """Names of the fields that are null on a record."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))


def vectors_of(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def checks_of_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.filter(F.col("check_run_id") == run_id)


def by_code_pattern(df: DataFrame, *patterns: str) -> DataFrame:
    """Listings whose code matches any of the LIKE patterns, such as '2%' or '%01'."""
    test = F.lit(False)
    for p in patterns:
        test = test | F.col("sport_season_code").like(p)
    return df.filter(test)

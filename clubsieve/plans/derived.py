"""Views that already carry columns computed by our own operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import levels, urls
from ..operators import mining, search
from .fixtures import SPLIT_DAY


def listings_x(t) -> DataFrame:
    """Listings with base domain, listing type and standard level."""
    df = t.view("listings")
    return df.withColumns({
        "base_domain": urls.base_domain(F.col("url_scraped")),
        "listing_type": levels.listing_type([F.col("division_name")], F.col("num_weeks"),
                                            F.col("individual_fee"), F.col("team_fee")),
        "standardized_comp_level": levels.standard_level(F.col("source_comp_level")),
    })


def active(t) -> DataFrame:
    return listings_x(t).filter(~F.col("is_archived") & (F.col("listing_type") == "league"))


def stored(t) -> DataFrame:
    """Listings known before the split day; `incoming` holds the later ones."""
    return listings_x(t).filter(F.col("updated_at") < F.lit(SPLIT_DAY).cast("date"))


def incoming(t) -> DataFrame:
    return listings_x(t).filter(F.col("updated_at") >= F.lit(SPLIT_DAY).cast("date"))


def links(t) -> DataFrame:
    return mining.page_links(t.table("pages"))


def linked(t) -> DataFrame:
    """Listings with the venue id of their venue name; the least id where names repeat."""
    names = t.view("venues").groupBy("venue_name").agg(F.min("venue_id").alias("venue_id"))
    return listings_x(t).join(names, "venue_name", "left")


def scored_links(t) -> DataFrame:
    """Page links with navigation score, type and category."""
    return mining.navigation_links(links(t), None)


def scored_site_links(t) -> DataFrame:
    """Links of the derived sites with navigation score, type and category."""
    return mining.navigation_links(t.view("site_links"), None)


def categorised_site_links(t) -> DataFrame:
    """Links of the derived sites that have a category."""
    return mining.categorised_links(t.view("site_links"))


def screened_results(t) -> DataFrame:
    return search.screen_results(t.view("results"))

"""The named table functions as temporary views and DataFrame functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls
from ..operators import joins, ranking, reports, vectors


def get_latest_league_checks(checks: DataFrame) -> DataFrame:
    return ranking.latest_checks(checks).select("check_id", "league_id", "checked_at", "old_num_teams", "new_num_teams", "status")


def get_urls_with_check_age(listings: DataFrame, checks: DataFrame) -> DataFrame:
    return joins.urls_with_check_age(listings, checks)


def get_domain_city_map(results: DataFrame, queries: DataFrame, url: Column | None = None) -> DataFrame:
    return reports.domain_city_map(results, queries, urls.base_domain(F.col("url_raw") if url is None else url))


def match_league_vectors(df: DataFrame, query: list[float], match_count: int = 10, similarity_threshold: float = 0.0) -> DataFrame:
    return vectors.similar(df, query, match_count, similarity_threshold)


def register_views(spark: SparkSession, listings: DataFrame, checks: DataFrame, results: DataFrame, queries: DataFrame) -> None:
    """Makes the table functions without arguments available to SQL as temporary views."""
    get_latest_league_checks(checks).createOrReplaceTempView("latest_league_checks")
    get_urls_with_check_age(listings, checks).createOrReplaceTempView("urls_with_check_age")
    get_domain_city_map(results, queries).createOrReplaceTempView("domain_city_map")

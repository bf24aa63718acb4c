"""Queries over the aggregate reports and ranked lists."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, scoring, urls
from ..operators import joins, ranking, reports
from .registry import query
from .report_sql import WORK_LIST_SQL
from .scalar_queries import _REASON
from .scoring_queries import NINE_COUNT, STATUS_SQL
from .filter_queries import VENUE_LINK_SQL, enriched
from .sql_parts import half_up


@query("a1_quality_summary", f"""
SELECT count(*) AS total, coalesce({half_up('sum(coalesce(quality_score, 0))', 'count(*)', 1)}, 0.0) AS avg_score,
  coalesce({half_up('100 * count(*) FILTER (quality_score >= 70)', 'count(*)', 1)}, 0.0) AS pct_good,
  coalesce({half_up('100 * count(*) FILTER (coalesce(quality_score, 0) < 50)', 'count(*)', 1)}, 0.0) AS pct_poor FROM active""", ("active",))
def _(t):
    return reports.quality_summary(t.active)


def coverage_sql(source, fields):
    return " UNION ALL ".join(f"SELECT '{f}' AS field, {half_up(f'100 * count({f})', 'count(*)', 1)} AS coverage_pct FROM {source}"
                              for f in fields)


@query("a2_field_coverage", coverage_sql("active", fv.COVERAGE_FIELDS), ("active",))
def _(t):
    return reports.field_coverage(t.active)


@query("a2_field_coverage_of_venues", coverage_sql("venues", ("address", "lat", "google_name", "google_place_id")), ("venues",))
def _(t):
    return reports.field_coverage(t.venues, ("address", "lat", "google_name", "google_place_id"))


def quality_by_sql(column, alias):
    return f"""
SELECT coalesce({column}, 'Unknown') AS {alias}, count(*) AS listings, {half_up('sum(quality_score)', 'count(*)', 1)} AS avg_score,
  {half_up('100 * count(*) FILTER (quality_score >= 70)', 'count(*)', 1)} AS pct_good FROM active GROUP BY 1"""


@query("a3_quality_by_organization", quality_by_sql("organization_name", "organization"), ("active",))
def _(t):
    return reports.quality_by(t.active, "organization_name", "organization")


@query("a4_quality_by_sport_code", quality_by_sql("sport_season_code", "sport_code"), ("active",))
def _(t):
    return reports.quality_by(t.active, "sport_season_code", "sport_code")


@query("a5_distinct_values", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM listings_x WHERE NOT is_archived AND {c} <> ''"
    for c in ("sport_name", "base_domain", "standardized_comp_level", "gender_eligibility")), ("listings_x",))
def _(t):
    return reports.distinct_values(t.listings_x.filter(~F.col("is_archived")),
                                   ["sport_name", "base_domain", "standardized_comp_level", "gender_eligibility"])


@query("a6_count_by_status", f"""
SELECT s.status, count(q.scrape_id) AS row_count FROM (VALUES {', '.join(f"('{s}')" for s in fv.QUEUE_STATUSES)}) s(status)
LEFT JOIN queue q ON q.status = s.status GROUP BY s.status""", ("queue",))
def _(t):
    return reports.count_by_status(t.queue)


@query("a7_duplicate_groups", """
WITH k AS (SELECT league_id, quality_score, url_scraped, trim(lower(organization_name)) AS key_organization_name,
    coalesce(trim(lower(sport_season_code)), '') AS key_sport_season_code, coalesce(cast(season_year AS varchar), '') AS key_season_year,
    coalesce(trim(lower(venue_name)), '') AS key_venue_name, coalesce(trim(lower(day_of_week)), '') AS key_day_of_week,
    coalesce(trim(lower(source_comp_level)), '') AS key_source_comp_level FROM active)
SELECT *, count(*) OVER (PARTITION BY key_organization_name, key_sport_season_code, key_season_year, key_venue_name, key_day_of_week,
  key_source_comp_level) AS group_size FROM k QUALIFY group_size > 1""", ("active",))
def _(t):
    return reports.duplicate_groups(t.active)


# Only verified venues are linked here, so that some names stay open.
VERIFIED_LINK_SQL = VENUE_LINK_SQL.replace("FROM venues", "FROM venues WHERE manually_verified")


def linked_to_verified(t):
    return joins.link_venues(t.listings_x, t.venues.filter("manually_verified"))


@query("a8_venue_progress", f"""
WITH {VERIFIED_LINK_SQL}
SELECT count(DISTINCT venue_name) AS total, count(DISTINCT venue_name) FILTER (venue_id IS NOT NULL) AS enriched,
  greatest(0, count(DISTINCT venue_name) - count(DISTINCT venue_name) FILTER (venue_id IS NOT NULL)) AS pending,
  (SELECT count(*) FROM venues WHERE NOT manually_verified AND confidence_score < 60) AS needs_review FROM linked""", ("listings_x", "venues"))
def _(t):
    return reports.venue_progress(linked_to_verified(t), t.venues)


@query("a9_unlinked_venue_names", f"""
WITH {VERIFIED_LINK_SQL} SELECT venue_name, count(*) AS league_count FROM linked
WHERE venue_id IS NULL AND venue_name IS NOT NULL GROUP BY venue_name""", ("listings_x", "venues"))
def _(t):
    return reports.unlinked_venue_names(linked_to_verified(t))


@query("a10_venue_listing_stats", f"""
WITH {VENUE_LINK_SQL} SELECT venue_id, count(*) AS num_leagues,
  {half_up('sum(team_fee * 100) / 100', 'count(team_fee)', 2).replace('cast(sum(team_fee * 100) / 100 AS hugeint)', 'cast(sum(cast(team_fee * 100 AS bigint)) AS hugeint)').replace('2 * 100 *', '2 *')} AS avg_team_fee,
  {half_up('sum(individual_fee)', 'count(individual_fee)', 2)} AS avg_individual_fee,
  array_to_string(list_sort(list_distinct(list(start_time) FILTER (start_time IS NOT NULL))), ',') AS hours
FROM linked WHERE venue_id IS NOT NULL GROUP BY venue_id""", ("listings_x", "venues"))
def _(t):
    return reports.venue_listing_stats(t.linked).withColumn("hours", F.array_join("hours", ","))


@query("a11_venue_sports_and_days", f"""
WITH {VENUE_LINK_SQL} SELECT venue_id, coalesce(array_to_string(sports, ','), '') AS sports,
  coalesce(array_to_string(days, ','), '') AS days_of_week FROM venue_sports""", ("listings_x", "venues"))
def _(t):
    return reports.venue_sports_and_days(t.linked).select(
        "venue_id", F.array_join("sports", ",").alias("sports"), F.array_join("days_of_week", ",").alias("days_of_week"))


@query("a12_url_work_list", WORK_LIST_SQL, ("listings_x",))
def _(t):
    return reports.url_work_list(t.listings_x.filter(~F.col("is_archived")))


@query("a13_quality_range_by_url", """
SELECT url_scraped AS url, count(*) AS league_count, min(quality_score) AS min_quality, max(quality_score) AS max_quality
FROM listings WHERE NOT is_archived GROUP BY url_scraped""", ("listings",))
def _(t):
    return reports.quality_range_by_url(t.listings)


_TYPES = ", ".join(f"count(*) FILTER (listing_type = '{x}') AS {x}" for x in fv.LISTING_TYPES)


@query("a14_domain_groups", f"SELECT base_domain AS domain, count(DISTINCT url_scraped) AS urls, {_TYPES} FROM listings_x GROUP BY 1", ("listings_x",))
def _(t):
    return reports.domain_groups(t.listings_x)


@query("a14_domain_totals", f"SELECT count(DISTINCT base_domain) AS organizations, {_TYPES} FROM listings_x", ("listings_x",))
def _(t):
    return reports.domain_totals(t.listings_x)


DOMAIN_CITY_SQL = """
SELECT array_to_string(string_split(regexp_extract(url_raw, '://([^/?]*)', 1), '.')[-2:], '.') AS domain, min(city) AS city
FROM results JOIN queries USING (query_id) WHERE city IS NOT NULL GROUP BY 1 HAVING count(DISTINCT city) = 1"""


@query("a15_domain_city_map", DOMAIN_CITY_SQL, ("results", "queries"))
def _(t):
    return reports.domain_city_map(t.results, t.queries, urls.base_domain(F.col("url_raw")))


def _gap(fields, flag):
    items = ", ".join(f"CASE WHEN bool_or({f} IS NOT NULL) = {flag} THEN '{f}' END" for f in sorted(fields))
    return f"concat_ws(',', {items})"


_FIELDS = tuple(fv.CATEGORY_OF_FIELD)


@query("a16_gap_report", f"""
SELECT base_domain, {_gap(_FIELDS, 'true')} AS covered, {_gap(_FIELDS, 'false')} AS missing,
  round((""" + " + ".join(f"bool_or({f} IS NOT NULL)::int" for f in _FIELDS) + ") * 100.0 / 19, 1) AS coverage_pct, "
       + ", ".join(f"{_gap([f for f in _FIELDS if fv.CATEGORY_OF_FIELD[f] == c], 'false')} AS missing_{c.lower()}" for c in fv.FIELD_CATEGORIES)
       + " FROM listings_x GROUP BY base_domain", ("listings_x",))
def _(t):
    r = reports.gap_report(t.listings_x, "base_domain")
    return r.select(*[F.array_join(c, ",").alias(c) if k.startswith("array") else F.col(c) for c, k in r.dtypes])


@query("a17_coverage_by_city_and_sport", "SELECT city, sport, count(*) AS query_count FROM queries GROUP BY city, sport", ("queries",))
def _(t):
    return reports.coverage_by_city_and_sport(t.queries)


def checked_results(t):
    """Results with their validation outcome."""
    return t.screened_results.withColumn("added_to_queue", F.col("is_valid") & (F.col("search_rank") <= 6))


_CHECKED = f"""checked AS (SELECT *, prefix({_REASON}, 'valid_') AS ok FROM results)"""


@query("a18_pass_rate_by_sport", f"""
WITH {_CHECKED} SELECT sport, count(*) AS total_results, count(*) FILTER (ok) AS passed,
  {half_up('100 * count(*) FILTER (ok)', 'count(*)', 1)} AS pass_rate FROM checked JOIN queries USING (query_id) GROUP BY sport""",
       ("results", "queries"))
def _(t):
    return reports.pass_rate_by_sport(t.queries, checked_results(t))


@query("a19_priority_status_counts", "SELECT priority, status, count(*) AS row_count FROM queue GROUP BY priority, status", ("queue",))
def _(t):
    return reports.priority_status_counts(t.queue)


@query("a20_rows_per_domain", """
SELECT array_to_string(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[-2:], '.') AS domain, count(*) AS row_count
FROM pages GROUP BY 1 ORDER BY row_count DESC, domain LIMIT 15""")
def _(t):
    return reports.rows_per_domain(t.table("pages"), urls.base_domain(F.col("url")))


@query("a21_campaign_summary", f"""
WITH {_CHECKED}, joined AS (SELECT q.query_id AS qid, q.city, q.status, r.ok, r.search_rank, r.result_id FROM queries q LEFT JOIN checked r USING (query_id))
SELECT city, count(DISTINCT qid) AS total_queries, count(DISTINCT qid) FILTER (status = 'COMPLETED') AS completed_queries,
  count(result_id) AS total_results, count(*) FILTER (ok) AS valid_results, count(*) FILTER (NOT ok) AS failed_results,
  count(*) FILTER (ok AND search_rank <= 6) AS added_to_queue,
  coalesce({half_up('100 * count(*) FILTER (ok)', 'count(result_id)', 1)}, 0.0) AS pass_rate FROM joined GROUP BY city""", ("results", "queries"))
def _(t):
    return reports.campaign_summary(t.queries, checked_results(t))


@query("a22_batch_summary", f"""
WITH runs AS (SELECT status = 'COMPLETED' AS success, q.scrape_id % 101 AS quality_score, q.scrape_id % 60 AS duration_seconds
  FROM queue q WHERE status IN ('COMPLETED', 'FAILED'))
SELECT count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed,
  {half_up('100 * count(*) FILTER (success)', 'count(*)', 1)} AS success_rate,
  {half_up('sum(quality_score)', 'count(*) FILTER (success)', 0)} AS avg_quality, sum(duration_seconds)::bigint AS total_duration,
  {half_up('sum(duration_seconds)', 'count(*)', 1)} AS avg_duration FROM runs""", ("queue",))
def _(t):
    k = F.col("scrape_id")
    runs = t.queue.filter(F.col("status").isin("COMPLETED", "FAILED")).select(
        (F.col("status") == "COMPLETED").alias("success"), (k % 101).alias("quality_score"), (k % 60).alias("duration_seconds"))
    return reports.batch_summary(runs)


@query("a23_type_counts", "SELECT listing_type, count(*) AS row_count FROM listings_x GROUP BY 1", ("listings_x",))
def _(t):
    return reports.counts_of(t.listings_x, "listing_type")


@query("a23_city_counts", """
SELECT CASE league_city WHEN 0 THEN 'Ottawa' WHEN 1 THEN 'North York' WHEN 3 THEN 'Calgary' END AS city, count(*) AS row_count
FROM (SELECT o_custkey % 4 AS league_city FROM orders) GROUP BY 1""")
def _(t):
    return reports.counts_of(t.listings.withColumn("city", urls.city_from_url(F.col("url_scraped"))), "city")


def with_pct(t):
    df = t.listings_x
    return df.withColumn("identifying_fields_pct", scoring.completeness(df))


@query("a24_page_flags", f"""
SELECT league_id, count(*) FILTER ({NINE_COUNT} >= 8) OVER (PARTITION BY url_scraped) >= 3 AS page_has_multi_leagues FROM listings""", ("listings",))
def _(t):
    return reports.page_flags(with_pct(t)).select("league_id", "page_has_multi_leagues")


CATEGORY_SQL = """
cat AS (SELECT *, CASE
    WHEN regexp_matches(said, 'register|signup|sign up|registration|enroll') THEN 'REGISTRATION'
    WHEN regexp_matches(said, 'schedule|games|game|times|fixtures|standings|results|scores|ranking') THEN 'SCHEDULE'
    WHEN regexp_matches(said, 'leagues|league info|divisions|competition') THEN 'DETAIL'
    WHEN regexp_matches(said, 'rules|format|regulations|policy|policies') THEN 'POLICY'
    WHEN regexp_matches(said, 'teams|team|roster') THEN 'SCHEDULE'
    WHEN regexp_matches(t, 'upcoming') THEN 'SCHEDULE' WHEN regexp_matches(t, 'payment|fees|pricing|cost') THEN 'REGISTRATION'
    WHEN regexp_matches(t, 'insurance|waiver|referee') THEN 'POLICY' WHEN regexp_matches(t, 'venue|location|facility|field|gym|arena|court') THEN 'VENUE'
    WHEN regexp_matches(t, 'league|division|program|season|current|calendar|about|sport|join|more info|volleyball|social|swimming') THEN 'DETAIL' END AS field_category
  FROM (SELECT *, lower(discovered_url || ' ' || anchor_text) AS said, lower(anchor_text) AS t FROM site_links))"""


@query("a25_category_coverage", f"""
WITH {CATEGORY_SQL}, dims AS (SELECT DISTINCT site_id, c.name FROM site_links, (VALUES ('SCHEDULE'), ('REGISTRATION'), ('POLICY'), ('VENUE'), ('DETAIL')) c(name))
SELECT d.site_id, d.name AS field_category, count(c.site_id) AS link_count, count(c.site_id) > 0 AS covered
FROM dims d LEFT JOIN cat c ON c.site_id = d.site_id AND c.field_category = d.name GROUP BY 1, 2""", ("site_links",))
def _(t):
    return reports.category_coverage(t.scored_site_links, "site_id")


@query("a26_page_completeness", f"""
SELECT url_scraped, count(*) AS leagues_extracted, round(sum({NINE_COUNT}) * 100.0 / 9 / count(*), 2) AS avg_completeness
FROM listings GROUP BY url_scraped""", ("listings",))
def _(t):
    return reports.page_completeness(with_pct(t))


@query("a27_venue_options", f"""
WITH {VENUE_LINK_SQL}
SELECT DISTINCT 'court_type_broad' AS "column", court_type_broad AS value FROM venues WHERE court_type_broad <> ''
UNION ALL SELECT DISTINCT 'court_type_specific', court_type_specific FROM venues
UNION ALL SELECT DISTINCT 'city', regexp_extract(address, 'Town NATION_[0-9]+', 0) FROM venues WHERE address IS NOT NULL
UNION ALL SELECT DISTINCT 'province', split_part(split_part(address, ', ', 3), ' ', 1) FROM venues WHERE address IS NOT NULL
UNION ALL SELECT DISTINCT 'sports', s FROM (SELECT unnest(sports) AS s FROM venue_sports)""", ("listings_x", "venues"))
def _(t):
    return reports.venue_options(enriched(t))


_BASE = ("day_of_week", "start_time", "venue_name", "num_weeks", "team_fee", "individual_fee", "registration_deadline")


@query("a28_null_baseline", f"""
SELECT count(*) AS total, count(*) FILTER (listing_type = 'league') AS selected,
  {', '.join(f'count(*) FILTER ({f} IS NULL) AS null_{f}' for f in _BASE)},
  {', '.join(f"count(*) FILTER ({f} IS NULL AND listing_type = 'league') AS selected_null_{f}" for f in _BASE)},
  count(*) FILTER (team_fee IS NULL AND individual_fee IS NULL) AS null_fees,
  round(sum({NINE_COUNT}) * 100.0 / 9 / count(*), 2) AS avg_completeness, {half_up('sum(quality_score)', 'count(*)', 2)} AS avg_quality
FROM listings_x""", ("listings_x",))
def _(t):
    return reports.null_baseline(with_pct(t), _BASE, F.col("listing_type") == "league")


def checks_with_status(t):
    return t.checks.withColumn("status", scoring.check_status(F.col("old_num_teams"), F.col("new_num_teams")))


LATEST_SQL = f"""
SELECT check_id, league_id, checked_at, old_num_teams, new_num_teams, {STATUS_SQL} AS status FROM checks
QUALIFY row_number() OVER (PARTITION BY league_id ORDER BY checked_at DESC, check_id) = 1"""


@query("w1_latest_checks", LATEST_SQL, ("checks",))
def _(t):
    return ranking.latest_checks(checks_with_status(t)).select(
        "check_id", "league_id", "checked_at", "old_num_teams", "new_num_teams", "status")


_DOMAIN = "array_to_string(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[-2:], '.')"


@query("w2_latest_snapshots", f"""
SELECT snapshot_id, {_DOMAIN} AS domain, created_at FROM snapshots
QUALIFY row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY created_at DESC, snapshot_id) = 1""", ("snapshots",))
def _(t):
    s = t.snapshots.select("snapshot_id", "created_at", urls.base_domain(F.col("url")).alias("domain"))
    return ranking.latest_snapshots(s)


@query("w3_first_by_normal_url", """
SELECT league_id, url_scraped FROM listings QUALIFY row_number() OVER (
  PARTITION BY replace(url_scraped, '://www.', '://') ORDER BY league_id) = 1""", ("listings",))
def _(t):
    df = t.listings.select("league_id", "url_scraped", urls.normalize_url(F.col("url_scraped")).alias("u"))
    return ranking.first_by_key(df, "u", "league_id").select("league_id", "url_scraped")


SITE_NAV_SQL = """
nav AS (SELECT *, CASE WHEN regexp_matches(u, 'logout|login|signin|admin|dashboard|profile') THEN greatest(0, raw - 50) ELSE raw END AS score FROM (
  SELECT *, CASE WHEN regexp_matches(said, '""" + "|".join(fv.NAV_STRUCTURE_WORDS) + """|volleyball|swimming|social') THEN 100 ELSE 0 END
    - CASE WHEN regexp_matches(said, '""" + "|".join(fv.NAV_NEGATIVE_WORDS) + """') THEN 100 ELSE 0 END
    - CASE WHEN contains(u, 'facebook') THEN 50 ELSE 0 END AS raw
  FROM (SELECT *, lower(discovered_url) AS u, lower(discovered_url || ' ' || anchor_text) AS said FROM site_links)))"""


@query("w4_best_links", f"""
WITH {SITE_NAV_SQL}, once AS (SELECT * FROM nav QUALIFY row_number() OVER (PARTITION BY source_url, discovered_url ORDER BY score DESC, position) = 1)
SELECT source_url, discovered_url, score, row_number() OVER (PARTITION BY source_url ORDER BY score DESC, position, discovered_url) AS link_rank
FROM once QUALIFY link_rank <= 3""", ("site_links",))
def _(t):
    df = t.scored_site_links
    once = ranking.best_row(df, ["source_url", "discovered_url"], [F.desc("score"), "position"])
    return ranking.top_n(once, "source_url", [F.desc("score"), "position", "discovered_url"], 3, "link_rank").select(
        "source_url", "discovered_url", "score", "link_rank")


@query("w5_top_per_category", f"""
WITH {CATEGORY_SQL} SELECT site_id, field_category, discovered_url, anchor_text FROM cat WHERE field_category IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY site_id, field_category ORDER BY position, discovered_url, source_url) <= 3""", ("site_links",))
def _(t):
    df = t.categorised_site_links
    return ranking.top_n(df, ["site_id", "field_category"], ["position", "discovered_url", "source_url"], 3).select(
        "site_id", "field_category", "discovered_url", "anchor_text")


@query("w6_top_with_overflow", f"""
WITH {CATEGORY_SQL} SELECT field_category, discovered_url, source_url,
  row_number() OVER (PARTITION BY field_category ORDER BY discovered_url, source_url) AS rank,
  greatest(0, count(*) OVER (PARTITION BY field_category) - 3) AS overflow FROM cat WHERE field_category IS NOT NULL QUALIFY rank <= 3""", ("site_links",))
def _(t):
    df = t.categorised_site_links
    return ranking.top_with_overflow(df, "field_category", ["discovered_url", "source_url"], 3).select(
        "field_category", "discovered_url", "source_url", "rank", "overflow")


@query("w7_survivors", """
SELECT organization_name, season_year, league_id, quality_score FROM active
QUALIFY row_number() OVER (PARTITION BY organization_name, season_year ORDER BY quality_score DESC, league_id) = 1""", ("active",))
def _(t):
    return ranking.survivors(t.active, ["organization_name", "season_year"]).select(
        "organization_name", "season_year", "league_id", "quality_score")


@query("w8_rank_of_status", """
SELECT scrape_id, status, row_number() OVER (PARTITION BY status ORDER BY scrape_id) AS rank FROM queue""", ("queue",))
def _(t):
    """Few groups, each with a large share of the rows, so every group is spread over ranges."""
    return ranking.rank_in_groups(t.queue.select("scrape_id", "status"), ["status"], ["scrape_id"])


@query("w8_rank_in_query", """
SELECT result_id, query_id, row_number() OVER (PARTITION BY query_id ORDER BY found_on, result_id) AS rank_in_query FROM results""", ("results",))
def _(t):
    return ranking.rank_within(t.results.select("result_id", "query_id", "found_on"), "query_id", ["found_on", "result_id"],
                               F.col("found_on"), "rank_in_query").select("result_id", "query_id", "rank_in_query")

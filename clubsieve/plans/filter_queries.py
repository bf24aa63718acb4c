"""Queries over filters and lists."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, levels, links as link_rules
from ..operators import filters, reports
from .registry import query
from .report_sql import WORK_LIST_SQL


@query("s1_table_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    return t.table("customer").select("c_custkey", "c_name", "c_acctbal")


@query("f1_active_listings", """
SELECT league_id, organization_name, sport_name, day_of_week, quality_score, base_domain FROM active
WHERE organization_name ILIKE '%customer%' AND sport_name IN ('Soccer', 'Volleyball') AND day_of_week IN ('Monday', 'Wednesday')
  AND gender_eligibility IN ('CoEd', 'Mens') AND quality_score BETWEEN 10 AND 90""", ("active",))
def _(t):
    return filters.active_listings(
        t.listings_x, org_search="customer", sport_names=["Soccer", "Volleyball"], days=["Monday", "Wednesday"],
        genders=["CoEd", "Mens"], quality_min=10, quality_max=90).select(
        "league_id", "organization_name", "sport_name", "day_of_week", "quality_score", "base_domain")


@query("f1_active_by_level_and_type", """
SELECT league_id, listing_type, standardized_comp_level FROM listings_x WHERE NOT is_archived
  AND listing_type IN ('drop_in', 'unknown') AND standardized_comp_level IN ('A', 'B+')""", ("listings_x",))
def _(t):
    return filters.active_listings(t.listings_x, listing_types=["drop_in", "unknown"], levels=["A", "B+"]).select(
        "league_id", "listing_type", "standardized_comp_level")


@query("f2_queue_filter", """
SELECT scrape_id, url, status, priority FROM queue WHERE status IN ('PENDING', 'FAILED') AND priority IN (1, 2)
  AND (url ILIKE '%org-1%' OR organization_name ILIKE '%org-1%')""", ("queue",))
def _(t):
    return filters.queue_filter(t.queue, ["PENDING", "FAILED"], [1, 2], "%org-'1").select(
        "scrape_id", "url", "status", "priority")


@query("f3_queue_page", """
SELECT scrape_id, status, priority, created_at FROM queue WHERE status = 'PENDING'
ORDER BY priority, created_at, scrape_id LIMIT 50 OFFSET 100""", ("queue",))
def _(t):
    return filters.queue_page(t.queue, 100, 50, statuses=["PENDING"]).select("scrape_id", "status", "priority", "created_at")


@query("f4_queue_row_count", """
SELECT count(*) AS row_count, (count(*) + 49) // 50 AS page_count FROM queue WHERE priority IN (2, 3) AND url ILIKE '%calgary%'""",
       ("queue",))
def _(t):
    return filters.queue_row_count(t.queue, 50, priorities=[2, 3], search="calgary")


@query("f5_claim_next", """
SELECT scrape_id, url, priority FROM queue WHERE status = 'PENDING' ORDER BY priority, created_at, scrape_id LIMIT 20""", ("queue",))
def _(t):
    return filters.claim_next(t.queue, 20).select("scrape_id", "url", "priority")


@query("f5_claim_all", "SELECT scrape_id, url, priority FROM queue WHERE status = 'PENDING'", ("queue",))
def _(t):
    return filters.claim_next(t.queue, 0).select("scrape_id", "url", "priority")


@query("f6_venues_to_review", """
SELECT venue_id, confidence_score FROM venues WHERE NOT manually_verified AND confidence_score < 60
ORDER BY confidence_score, venue_id LIMIT 50""", ("venues",))
def _(t):
    return filters.venues_to_review(t.venues).select("venue_id", "confidence_score")


@query("f7_venues_to_classify", """
SELECT venue_id, venue_name, google_name, address FROM venues WHERE lat IS NOT NULL AND court_type_broad IS NULL""", ("venues",))
def _(t):
    return filters.venues_to_classify(t.venues).select("venue_id", "venue_name", "google_name", "address")


VENUE_LINK_SQL = """
linked AS (SELECT l.*, v.venue_id FROM listings_x l LEFT JOIN (SELECT venue_name, min(venue_id) AS venue_id FROM venues GROUP BY 1) v
  USING (venue_name)),
sport_names(code, sport) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in fv.SPORT_BY_NUMBER.items()) + """),
venue_sports AS (SELECT venue_id, list_sort(list_distinct(list(sport) FILTER (sport IS NOT NULL))) AS sports,
    list_sort(list_distinct(list(day_of_week) FILTER (day_of_week <> ''))) AS days
  FROM linked LEFT JOIN sport_names ON code = right(sport_season_code, 2) AND length(sport_season_code) = 3
  WHERE venue_id IS NOT NULL GROUP BY venue_id)"""


def enriched(t):
    """Venues with address parts and the sports and days of their listings."""
    a = F.col("address")
    return (t.venues.withColumns({"city": levels.city_of_address(a), "province": levels.province(a)})
            .join(reports.venue_sports_and_days(t.linked), "venue_id", "left"))


@query("f8_enriched_venues", f"""
WITH {VENUE_LINK_SQL}
SELECT venue_id, venue_name, address FROM venues v WHERE lat IS NOT NULL AND court_type_broad = 'Outdoor'
  AND contains(address, ', QC ') AND address ILIKE '%town%'
  AND EXISTS (SELECT 1 FROM venue_sports s WHERE s.venue_id = v.venue_id AND list_contains(sports, 'Soccer'))
  AND EXISTS (SELECT 1 FROM linked l WHERE l.venue_id = v.venue_id AND season_name ILIKE '%winter%')""",
       ("listings_x", "venues"))
def _(t):
    return filters.enriched_venues(enriched(t), t.linked, broad="Outdoor", province="QC", city="town",
                                   sport="Soccer", season="winter").select("venue_id", "venue_name", "address")


@query("f9_venue_list", "SELECT venue_id, venue_name, confidence_score FROM venues", ("venues",))
def _(t):
    a = F.col("address")
    return filters.venue_list(t.venues.withColumn("city", levels.city_of_address(a))).select(
        "venue_id", "venue_name", "confidence_score")


@query("f9_listings_of_venue", """
SELECT league_id, organization_name, sport_name, season_name, day_of_week, stat_holidays FROM listings WHERE lower(venue_name) = 'venue 7'""",
       ("listings",))
def _(t):
    return filters.listings_of_venue(t.listings, venue_name="VENUE 7").select(
        "league_id", "organization_name", "sport_name", "season_name", "day_of_week", "stat_holidays")


@query("f9_listings_of_venue_id", f"""
WITH {VENUE_LINK_SQL} SELECT league_id, day_of_week FROM linked WHERE venue_id = 7""", ("listings_x", "venues"))
def _(t):
    return filters.listings_of_venue(t.linked, venue_id=7).select("league_id", "day_of_week")


SCORED_SQL = f"""
scored AS (SELECT *, concat(lower(discovered_url), ' ', lower(anchor_text)) AS said FROM links),
marked AS (SELECT *, CASE WHEN regexp_matches(said, '{'|'.join(fv.NAV_STRUCTURE_WORDS + link_rules.sport_words())}') THEN 100 ELSE 0 END
    - CASE WHEN regexp_matches(said, '{'|'.join(fv.NAV_NEGATIVE_WORDS)}') THEN 100 ELSE 0 END
    - CASE WHEN regexp_matches(lower(discovered_url), '{'|'.join(fv.NAV_SOCIAL_WORDS)}') THEN 50 ELSE 0 END AS raw FROM scored),
nav AS (SELECT *, CASE WHEN regexp_matches(lower(discovered_url), '{'|'.join(fv.NAV_ACCOUNT_WORDS)}') THEN greatest(0, raw - 50) ELSE raw END AS score
  FROM marked)"""


@query("f10_links_by_score", f"WITH {SCORED_SQL} SELECT page_id, position, discovered_url, score FROM nav WHERE score >= 100", ("links",))
def _(t):
    return filters.links_of(t.scored_links, min_score=100).select("page_id", "position", "discovered_url", "score")


@query("f10_links_of_type", """
SELECT source_url, position, discovered_url FROM site_links
WHERE regexp_matches(concat(lower(discovered_url), ' ', lower(anchor_text)), 'schedule|games|game|times|fixtures')
  AND NOT regexp_matches(concat(lower(discovered_url), ' ', lower(anchor_text)), 'register|signup|sign up|registration|enroll')""", ("site_links",))
def _(t):
    return filters.links_of(t.scored_site_links, page_type="schedule").select("source_url", "position", "discovered_url")


@query("f11_unprocessed_links", f"""
WITH {SCORED_SQL} SELECT page_id, position, score FROM nav WHERE position % 3 < 2
ORDER BY score DESC, source_url, position LIMIT 25""", ("links",))
def _(t):
    status = F.when(F.col("position") % 3 == 1, "pending").when(F.col("position") % 3 == 2, "done")
    return filters.unprocessed_links(t.scored_links.withColumn("status", status), 25).select("page_id", "position", "score")


@query("f12_low_quality", "SELECT league_id, quality_score FROM active WHERE coalesce(quality_score, 0) < 50", ("active",))
def _(t):
    return filters.low_quality(t.active).select("league_id", "quality_score")


@query("f13_work_list_filter", f"""
SELECT url, org_name, league_count, avg_quality, avg_missing FROM ({WORK_LIST_SQL})
WHERE (org_name ILIKE '%org-12%' OR base_domain ILIKE '%org-12%' OR url ILIKE '%org-12%') AND avg_quality BETWEEN 20 AND 80""", ("listings_x",))
def _(t):
    work = reports.url_work_list(t.listings_x.filter(~F.col("is_archived")))
    return filters.filter_work_list(work, "org-12", 20, 80, "missing_most").select(
        "url", "org_name", "league_count", "avg_quality", "avg_missing")


@query("f14_listings_of_site", """
SELECT league_id, url_scraped FROM listings WHERE organization_name ILIKE '%000001%' AND contains(lower(url_scraped), 'org-1')""",
       ("listings",))
def _(t):
    return filters.listings_of_site(t.listings, org="000001", host="org-1").select("league_id", "url_scraped")


@query("f15_missing_fields", "SELECT league_id, concat_ws(',', " + ", ".join(
    f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in fv.ENRICHABLE_FIELDS) + ") AS missing FROM listings", ("listings",))
def _(t):
    df = t.listings
    return df.select("league_id", F.array_join(filters.missing_fields(df), ",").alias("missing"))


@query("f16_vectors_of", "SELECT vec_id, label, len(embedding) AS dims FROM embeddings WHERE label = 3")
def _(t):
    return filters.vectors_of(t.table("embeddings"), "label", 3).select("vec_id", "label", F.size("embedding").alias("dims"))


@query("f17_checks_of_run", "SELECT check_id, league_id, new_num_teams FROM checks WHERE check_run_id = 'run-2'", ("checks",))
def _(t):
    return filters.checks_of_run(t.checks, "run-2").select("check_id", "league_id", "new_num_teams")


@query("f18_code_patterns", """
SELECT league_id, sport_season_code FROM listings WHERE left(sport_season_code, 1) = '2' OR right(sport_season_code, 2) = '01'
  OR sport_season_code = '311' OR sport_season_code[2] = '1'""", ("listings",))
def _(t):
    return filters.by_code_pattern(t.listings, "2%", "%01", "311", "_1_").select("league_id", "sport_season_code")

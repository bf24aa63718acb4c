"""Queries over lookups, fuzzy matches and as-of joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, urls
from ..operators import asof, joins, matching, search
from .filter_queries import VENUE_LINK_SQL
from .fixtures import SPLIT_DAY
from .registry import query
from .report_queries import DOMAIN_CITY_SQL, checks_with_status
from .scalar_queries import _REASON
from .scoring_queries import STATUS_SQL, as_of
from .sql_parts import CASE_CITY, RATIO_SQL

CITY_PASSES = """
found AS (SELECT url, min(city) AS city FROM queue JOIN results ON source_result_id = result_id JOIN queries USING (query_id) GROUP BY url)"""


@query("j1_city_from_search", f"""
WITH {CITY_PASSES} SELECT league_id, found.city FROM listings LEFT JOIN found ON url = url_scraped""", ("listings", "queue", "results", "queries"))
def _(t):
    df = t.listings.select("league_id", "url_scraped", F.lit(None).cast("string").alias("city"))
    return joins.backfill_city_from_search(df, t.queue, t.results, t.queries).select("league_id", "city")


@query("j2_urls_with_check_age", f"""
SELECT url_scraped, organization_name AS org_name, count(DISTINCT l.league_id) AS league_count, max(checked_at) AS last_checked_at,
  bool_or({STATUS_SQL} = 'CHANGED') FILTER (check_id IS NOT NULL) AS has_changes
FROM listings l LEFT JOIN checks c USING (league_id) WHERE NOT is_archived GROUP BY ALL""", ("listings", "checks"))
def _(t):
    return joins.urls_with_check_age(t.listings, checks_with_status(t))


@query("j3_venues_in_season", f"""
WITH {VENUE_LINK_SQL} SELECT venue_id, venue_name FROM venues WHERE venue_id IN (SELECT venue_id FROM linked WHERE season_name ILIKE '%fall%')""",
       ("listings_x", "venues"))
def _(t):
    return joins.venues_in_season(t.venues, t.linked, "fall").select("venue_id", "venue_name")


SCREENED = f"""
screened AS (SELECT *, prefix({_REASON}, 'valid_') AS ok,
    CASE WHEN suffix(url_raw, '/') THEN left(lower(url_raw), length(url_raw) - 1) ELSE replace(lower(url_raw), '?utm_source=x', '') END.replace('://www.', '://') AS u
  FROM results),
free AS (SELECT * FROM screened s WHERE ok AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.status IN ('PENDING', 'IN_PROGRESS') AND q.url = s.u)
    AND NOT EXISTS (SELECT 1 FROM listings l WHERE l.url_scraped = s.u))"""


@query("j4_queue_additions", f"""
WITH {SCREENED} SELECT u AS url, result_id AS source_result_id, 'PENDING' AS status FROM free
QUALIFY row_number() OVER (PARTITION BY u ORDER BY result_id) = 1""", ("results", "queue", "listings"))
def _(t):
    return search.queue_additions(t.screened_results, t.queue, t.listings).select("url", "source_result_id", "status")


@query("j4_queue_plan", f"""
WITH {SCREENED},
canon_queue AS (SELECT DISTINCT lower(replace(url, '://www.', '://')) AS u FROM queue WHERE status IN ('PENDING', 'IN_PROGRESS')),
canon_listings AS (SELECT DISTINCT lower(replace(url_scraped, '://www.', '://')) AS u FROM listings WHERE is_archived)
SELECT result_id, CASE WHEN u IN (SELECT u FROM canon_queue) THEN 'SKIPPED_QUEUED' WHEN u IN (SELECT u FROM canon_listings) THEN 'SKIPPED_SCRAPED'
  WHEN result_id > min(result_id) OVER (PARTITION BY u) THEN 'SKIPPED_REPEATED' ELSE 'ADDED' END AS action FROM screened WHERE ok""",
       ("results", "queue", "listings"))
def _(t):
    queue = t.queue.withColumn("url", urls.canonicalize_url(F.col("url")))
    listings = t.listings.filter("is_archived").withColumn("url_scraped", urls.canonicalize_url(F.col("url_scraped")))
    return search.queue_plan(t.screened_results, queue, listings).select("result_id", "action")


def past_queries(t):
    none = F.lit(None).cast("string")
    return t.queries.withColumn("query_fingerprint", keys.fingerprint(
        F.col("city"), none, F.lit("CA"), F.col("sport"), F.col("season"), none.cast("int")))


def city_grid(t):
    sports = ["BUILDING", "MACHINERY", "soccer"]
    return search.query_grid(t.queries.select("city").distinct(), sports, [None, "summer"], country="CA")


GRID_SQL = """
grid AS (SELECT DISTINCT city, sport, season FROM queries, (VALUES ('BUILDING'), ('MACHINERY'), ('soccer')) s(sport), (VALUES (NULL), ('summer')) z(season)),
grid2 AS (SELECT g.city, g.sport, g.season, concat_ws(' ', g.city, g.season, g.sport, 'league') AS query_text,
    concat(lower(g.city), '||ca|', lower(g.sport), '|', coalesce(g.season, ''), '|') AS query_fingerprint
  FROM (SELECT DISTINCT q.city, s.sport, z.season FROM queries q, (VALUES ('BUILDING'), ('MACHINERY'), ('soccer')) s(sport), (VALUES (NULL), ('summer')) z(season)) g)"""


@query("j5_new_queries", f"""
WITH {GRID_SQL} SELECT city, sport, season, query_text FROM grid2 WHERE query_fingerprint NOT IN (
  SELECT concat(lower(city), '||ca|', lower(sport), '||') FROM queries WHERE search_date >= date '2000-06-30' - 30)""", ("queries",))
def _(t):
    return search.new_queries(city_grid(t), past_queries(t), as_of()).select("city", "sport", "season", "query_text")


@query("j5_mark_recent", f"""
WITH {GRID_SQL} SELECT city, sport, season, query_fingerprint IN (
  SELECT concat(lower(city), '||ca|', lower(sport), '||') FROM queries WHERE search_date >= date '2000-06-30' - 30) AS is_duplicate FROM grid2""", ("queries",))
def _(t):
    return search.mark_recent(city_grid(t), past_queries(t), as_of()).select("city", "sport", "season", "is_duplicate")


@query("j6_query_grid", f"WITH {GRID_SQL} SELECT city, sport, season, query_text, query_fingerprint FROM grid2", ("queries",))
def _(t):
    return city_grid(t).select("city", "sport", "season", "query_text", "query_fingerprint")


_KEYS = {"organization_name": "lower(organization_name)", "sport_name": "trim(lower(sport_name))",
         "season_year": "coalesce(greatest(year(season_start_date), year(season_end_date)), year(season_start_date), year(season_end_date))",
         "venue_name": "lower(venue_name)", "day_of_week": "lower(day_of_week)", "source_comp_level": "lower(source_comp_level)",
         "gender_eligibility": "lower(gender_eligibility)", "num_weeks": "num_weeks", "players_per_side": "players_per_side"}
KEYED_SQL = "SELECT league_id, base_domain, updated_at, quality_score, " + ", ".join(f"{e} AS k_{f}" for f, e in _KEYS.items()) + " FROM listings_x"
_OVERLAP = "(" + " + ".join(f"CASE WHEN i.k_{f} = s.k_{f} THEN 1 ELSE 0 END" for f in _KEYS) + ")"
_AGREE = " AND ".join(f"(i.k_{f} = s.k_{f} OR i.k_{f} IS NULL OR s.k_{f} IS NULL)" for f in _KEYS)


def match_sql(least):
    return f"""
keyed AS ({KEYED_SQL}),
best AS (SELECT i.league_id, s.league_id AS match_id, {_OVERLAP} AS overlap FROM keyed i JOIN keyed s USING (base_domain)
  WHERE i.updated_at >= date '{SPLIT_DAY}' AND s.updated_at < date '{SPLIT_DAY}' AND {_AGREE} AND {_OVERLAP} >= {least}
  QUALIFY row_number() OVER (PARTITION BY i.league_id ORDER BY {_OVERLAP} DESC, s.league_id) = 1)"""


@query("j7_best_matches", f"WITH {match_sql(3)} SELECT league_id, match_id, overlap FROM best", ("listings_x",))
def _(t):
    return matching.best_matches(t.incoming, t.stored)


@query("j8_best_matches_relaxed", f"WITH {match_sql(1)} SELECT league_id, match_id, overlap FROM best", ("listings_x",))
def _(t):
    return matching.best_matches(t.incoming, t.stored, min_overlap=1)


def named_checks(t):
    return t.checks.join(t.listings.select("league_id", F.col("url_scraped").alias("url")), "league_id").select("check_id", "url", "division_name")


@query("j9_match_divisions", f"""
WITH named AS (SELECT check_id, url_scraped AS url, c.division_name FROM checks c JOIN listings l USING (league_id)),
labels AS (SELECT url_scraped AS url, lower(concat_ws(' ', nullif(day_of_week, ''), nullif(gender_eligibility, ''), nullif(source_comp_level, ''))) AS b,
  min(league_id) AS league_id, count(*) AS n FROM listings WHERE NOT is_archived GROUP BY ALL),
asked AS (SELECT DISTINCT url, lower(division_name) AS a FROM named WHERE division_name <> ''),
pairs AS (SELECT DISTINCT a, b FROM asked JOIN labels USING (url)), {RATIO_SQL},
best AS (SELECT url, a, league_id, round(ratio, 6) AS ratio FROM asked JOIN labels USING (url) JOIN ratios USING (a, b) WHERE ratio >= 0.4
  QUALIFY row_number() OVER (PARTITION BY url, a ORDER BY ratio DESC, league_id) = 1),
single AS (SELECT url, min(league_id) AS only_id FROM labels GROUP BY url HAVING sum(n) = 1)
SELECT n.check_id, n.url, n.division_name, best.ratio, CASE WHEN coalesce(n.division_name, '') = '' THEN only_id ELSE best.league_id END AS league_id
FROM named n LEFT JOIN best ON best.url = n.url AND best.a = lower(n.division_name) LEFT JOIN single ON single.url = n.url""", ("RECURSIVE", "listings", "checks"))
def _(t):
    return matching.match_divisions(named_checks(t), t.listings.filter(~F.col("is_archived")))


@query("j10_city_with_fallback", f"""
WITH domains AS ({DOMAIN_CITY_SQL})
SELECT league_id, coalesce({CASE_CITY}, d.city) AS city, CASE WHEN {CASE_CITY} IS NOT NULL THEN 'url_path' WHEN d.city IS NOT NULL THEN 'search' ELSE 'none' END AS city_source
FROM listings LEFT JOIN domains d ON d.domain = regexp_extract(url_scraped, '://www\\.([^/]+)', 1)""", ("listings", "results", "queries"))
def _(t):
    return joins.city_with_fallback(t.listings, t.screened_results, t.queries).select("league_id", "city", "city_source")


@query("j11_link_venues", f"WITH {VENUE_LINK_SQL} SELECT league_id, venue_id FROM linked", ("listings_x", "venues"))
def _(t):
    return joins.link_venues(t.listings, t.venues).select("league_id", "venue_id")


def page_parents(t):
    """Sub-pages 1 and 2 of a path hang below page 0."""
    return t.listings.select(F.col("url_scraped").alias("child_url")).distinct().filter("child_url NOT LIKE '%/0'").withColumn(
        "parent_url", F.regexp_replace("child_url", "/[12]$", "/0"))


@query("j12_true_children", """
SELECT league_id FROM listings c WHERE NOT suffix(url_scraped, '/0') AND sport_name IS NOT NULL AND EXISTS (
  SELECT 1 FROM listings p WHERE p.url_scraped = left(c.url_scraped, length(c.url_scraped) - 1) || '0' AND trim(lower(p.sport_name)) = trim(lower(c.sport_name)))""",
       ("listings",))
def _(t):
    return matching.true_children(t.listings, page_parents(t))


@query("j13_fill_counts", """
WITH f AS (SELECT league_id, min(new_num_teams) AS n FROM checks WHERE new_num_teams <> 0 GROUP BY 1)
SELECT league_id, CASE WHEN coalesce(num_teams, 0) = 0 THEN coalesce(n, num_teams) ELSE num_teams END AS num_teams FROM listings LEFT JOIN f USING (league_id)""",
       ("listings", "checks"))
def _(t):
    return joins.fill_counts(t.listings, t.checks.select("league_id", F.col("new_num_teams").alias("found_teams"))).select("league_id", "num_teams")


SAME_DAY_SQL = f"""
inc AS (SELECT * FROM listings WHERE updated_at >= date '{SPLIT_DAY}'), old AS (SELECT * FROM listings WHERE updated_at < date '{SPLIT_DAY}'),
existing AS (SELECT i.league_id, CASE WHEN count(o.league_id) = 1 THEN min(o.league_id)
    ELSE min(o.league_id) FILTER (coalesce(o.day_of_week, '') = coalesce(i.day_of_week, '')) END AS existing_id
  FROM inc i LEFT JOIN old o USING (url_scraped) GROUP BY i.league_id)"""


@query("j14_same_day_or_only", f"WITH {SAME_DAY_SQL} SELECT league_id, existing_id FROM existing", ("listings",))
def _(t):
    return matching.same_day_or_only(t.incoming, t.stored).select("league_id", "existing_id")


@query("j15_code_names", """
SELECT league_id, CASE left(sport_season_code, 1) WHEN '1' THEN 'Spring' WHEN '2' THEN 'Summer' WHEN '3' THEN 'Fall' WHEN '4' THEN 'Winter'
    WHEN '5' THEN 'Spring/Summer' WHEN '6' THEN 'Fall/Winter' WHEN '7' THEN 'Tournament' WHEN '8' THEN 'Youth' WHEN '9' THEN 'Other' END AS season,
  CASE right(sport_season_code, 2) WHEN '01' THEN 'Soccer' WHEN '02' THEN 'Flag Football' WHEN '03' THEN 'Ultimate Frisbee' WHEN '04' THEN 'Rugby'
    WHEN '05' THEN 'Lacrosse' WHEN '06' THEN 'Cricket' WHEN '07' THEN 'Kickball' WHEN '08' THEN 'Field Hockey' WHEN '10' THEN 'Basketball'
    WHEN '11' THEN 'Volleyball' WHEN '12' THEN 'Badminton' END AS sport FROM listings""", ("listings",))
def _(t):
    return joins.code_names(t.listings).select("league_id", "season", "sport")


_DOMAIN = "array_to_string(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[-2:], '.')"


@query("j16_fresh_snapshots", f"""
SELECT domain, snapshot_id, created_at FROM (SELECT *, {_DOMAIN} AS domain FROM snapshots WHERE created_at <= date '2000-06-25')
WHERE created_at >= date '2000-06-25' - 7 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, snapshot_id) = 1""", ("snapshots",))
def _(t):
    snaps = t.snapshots.withColumn("domain", urls.base_domain(F.col("url"))).select("domain", "snapshot_id", "created_at")
    return joins.fresh_snapshots(snaps, F.lit("2000-06-25").cast("date"), "domain")


@query("j16_fresh_url_snapshots", """
SELECT url, snapshot_id FROM snapshots WHERE created_at BETWEEN date '2000-06-30' - 7 AND date '2000-06-30'
QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_at DESC, snapshot_id) = 1""", ("snapshots",))
def _(t):
    return joins.fresh_snapshots(t.snapshots.select("url", "snapshot_id", "created_at"), as_of()).select("url", "snapshot_id")


@query("j16_snapshots_at_checks", """
WITH one AS (SELECT snapshot_id % 40 AS site, created_at, min(snapshot_id) AS snapshot_id FROM snapshots GROUP BY ALL)
SELECT check_id, CASE WHEN one.created_at >= c.checked_at - 7 THEN one.snapshot_id END AS snapshot_id
FROM checks c ASOF LEFT JOIN one ON c.league_id % 40 = one.site AND c.checked_at >= one.created_at""", ("snapshots", "checks"))
def _(t):
    """The snapshot of its site that was fresh when a check was made; sites are made of the ids, as no URL is in both tables."""
    site = lambda c: (F.col(c) % 40).alias("site")
    checks = t.checks.select("check_id", site("league_id"), "checked_at")
    snaps = t.snapshots.select("snapshot_id", site("snapshot_id"), "created_at")
    return asof.latest_before(checks, snaps, ["site"], "checked_at", "created_at", "snapshot_id", within_days=7).select("check_id", F.col("state.snapshot_id").alias("snapshot_id"))


@query("j17_fresh_batches", """
WITH p AS (SELECT *, regexp_extract(url, '://([^/?#]*)', 1) AS site, created_at AS batch FROM snapshots),
fresh AS (SELECT site FROM p GROUP BY site HAVING max(batch) >= date '2000-06-30' - 7),
sound AS (SELECT * FROM p WHERE length(content) >= 1000 AND (snapshot_id % 5 = 0 OR contains(content, '<article')) AND site IN (SELECT site FROM fresh))
SELECT snapshot_id, site, batch FROM sound QUALIFY batch = max(batch) OVER (PARTITION BY site)""", ("snapshots",))
def _(t):
    snaps = t.snapshots.select("snapshot_id", urls.host(F.col("url")).alias("site"), F.col("created_at").alias("batch"), "content",
                               (F.col("snapshot_id") % 5 == 0).alias("is_summary"))
    return joins.fresh_batches(snaps, as_of(), "<article").select("snapshot_id", "site", "batch")

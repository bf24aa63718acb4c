"""Listing-shaped views derived from the given tables.

The test tables hold no listings, so each view maps a whole table to the domain's shape with
plain SQL that Spark and DuckDB both accept. {name} stands for a given table.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2000-06-30"
SPLIT_DAY = "1999-06-01"

_URL = """concat('https://www.org-', o_custkey, '.com/',
    case o_custkey % 4 when 0 then 'ottawa' when 1 then 'north-york-spring' when 2 then 'leagues'
         else 'Calgary' end, '/', o_orderkey % 3)"""

VIEWS = {
    "listings": f"""
SELECT o_orderkey AS league_id,
  c_name AS organization_name,
  {_URL} AS url_scraped,
  CASE WHEN o_orderkey % 11 = 0 THEN null WHEN o_orderkey % 17 = 0 THEN 'V10'
       ELSE concat(1 + o_custkey % 9, lpad(cast(o_custkey % 13 AS string), 2, '0')) END AS sport_season_code,
  CASE o_custkey % 5 WHEN 0 THEN 'Soccer' WHEN 1 THEN 'Volleyball' WHEN 2 THEN 'Softball'
       WHEN 3 THEN 'soccer ' ELSE null END AS sport_name,
  CASE o_orderkey % 4 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Late Winter' WHEN 2 THEN 'Fall' ELSE null END AS season_name,
  CASE WHEN o_orderkey % 6 = 0 THEN null ELSE cast(o_orderdate AS date) END AS season_start_date,
  CASE WHEN o_orderkey % 10 = 0 THEN null
       WHEN o_orderkey % 23 = 0 THEN cast(cast(o_orderdate AS date) - interval 7 day AS date)
       WHEN o_orderkey % 29 = 0 THEN cast(cast(o_orderdate AS date) + interval 400 day AS date)
       ELSE cast(cast(o_orderdate AS date) + interval 70 day AS date) END AS season_end_date,
  year(o_orderdate) AS season_year,
  CASE WHEN o_orderkey % 7 = 0 THEN null ELSE concat('Venue ', o_custkey % 40) END AS venue_name,
  CASE o_orderkey % 4 WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' ELSE null END AS day_of_week,
  CASE o_orderkey % 5 WHEN 1 THEN 'Competitive' WHEN 2 THEN 'High Intermediate'
       WHEN 3 THEN 'rec/intermediate' WHEN 4 THEN 'Novice' ELSE null END AS source_comp_level,
  CASE o_orderkey % 3 WHEN 1 THEN 'CoEd' WHEN 2 THEN 'Mens' ELSE null END AS gender_eligibility,
  CASE WHEN o_orderkey % 4 = 0 THEN null ELSE cast(1 + o_custkey % 12 AS int) END AS num_weeks,
  CASE WHEN o_orderkey % 2 = 0 THEN null ELSE cast(4 + o_custkey % 3 AS int) END AS players_per_side,
  CASE WHEN o_orderkey % 8 = 0 THEN null ELSE cast(o_orderkey % 25 AS int) END AS num_teams,
  CASE WHEN o_orderkey % 3 = 0 THEN null ELSE cast(o_totalprice AS decimal(12,2)) END AS team_fee,
  CASE WHEN o_orderkey % 5 < 2 THEN cast(10 + o_custkey % 30 AS decimal(10,2)) ELSE null END AS individual_fee,
  CASE WHEN o_orderkey % 9 = 0 THEN null ELSE concat(17 + o_orderkey % 6, ':30:00') END AS start_time,
  CASE WHEN o_orderkey % 4 = 1 THEN null ELSE o_orderkey % 2 = 0 END AS has_referee,
  CASE WHEN o_orderkey % 5 = 0 THEN null ELSE cast(45 + 15 * (o_orderkey % 3) AS int) END AS time_played_per_week,
  CASE WHEN o_orderkey % 3 = 1 THEN null
       ELSE cast(cast(o_orderdate AS date) - interval 14 day AS date) END AS registration_deadline,
  CASE WHEN o_orderkey % 12 = 0 THEN 'Labour Day' ELSE null END AS stat_holidays,
  CASE WHEN o_orderkey % 7 < 4 THEN null ELSE cast(o_orderkey % 10 AS int) END AS slots_left,
  CASE WHEN o_orderkey % 6 < 3 THEN null ELSE o_orderkey % 2 = 1 END AS requires_insurance,
  CASE WHEN o_orderkey % 15 = 0 THEN concat('/policy/', o_custkey) ELSE null END AS insurance_policy_link,
  CASE o_orderkey % 12 WHEN 0 THEN 'Drop-in Night' WHEN 1 THEN 'Pick Up Social'
       ELSE concat('Division ', o_orderkey % 4) END AS division_name,
  cast(o_orderkey % 101 AS int) AS quality_score,
  o_orderkey % 20 = 0 AS is_archived,
  cast(o_orderdate AS date) AS updated_at
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "queue": f"""
SELECT o_orderkey AS scrape_id, {_URL} AS url,
  CASE o_orderkey % 6 WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'FAILED'
       ELSE 'PENDING' END AS status,
  cast(1 + o_orderkey % 3 AS int) AS priority,
  CASE WHEN o_orderkey % 13 = 0 THEN null ELSE c_name END AS organization_name,
  CASE WHEN o_orderkey % 5 = 0 THEN null ELSE cast(o_orderkey % 4 AS int) END AS scrape_attempts,
  o_orderkey AS source_result_id,
  cast(o_orderdate AS date) AS created_at
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "checks": """
SELECT (l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey % 1000 AS check_id, concat('run-', l_linenumber) AS check_run_id,
  l_orderkey AS league_id, cast(l_shipdate AS date) AS checked_at,
  CASE WHEN l_linenumber = 1 THEN null ELSE cast(l_quantity AS int) END AS old_num_teams,
  cast(l_suppkey % 30 AS int) AS new_num_teams,
  CASE WHEN l_linenumber = 2 THEN null
       ELSE concat(CASE l_partkey % 4 WHEN 0 THEN 'monday ' WHEN 1 THEN 'tues ' WHEN 2 THEN 'wednesday ' ELSE '' END,
                   CASE l_partkey % 3 WHEN 0 THEN 'coed ' WHEN 1 THEN 'mens ' ELSE '' END,
                   CASE l_suppkey % 3 WHEN 0 THEN 'competitive' WHEN 1 THEN 'intermediate' ELSE 'novice' END)
  END AS division_name
FROM {lineitem}""",
    "queries": """
SELECT c_custkey AS query_id, concat('City ', c_nationkey) AS city, c_mktsegment AS sport,
  cast(null AS string) AS season,
  CASE WHEN c_custkey % 4 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  date '1999-01-01' + cast((c_custkey * 7) % 1500 AS int) AS search_date
FROM {customer}""",
    "results": f"""
SELECT o_orderkey AS result_id, o_custkey AS query_id,
  CASE WHEN o_orderkey % 37 = 0 THEN concat({_URL}, '.pdf')
       WHEN o_orderkey % 41 = 0 THEN concat('https://www.facebook.com/org', o_custkey)
       WHEN o_orderkey % 43 = 0 THEN concat('https://m.yelp.com/biz/', o_custkey)
       WHEN o_orderkey % 47 = 0 THEN concat('https://', o_custkey, '12.example.biz/x')
       WHEN o_orderkey % 3 = 0 THEN concat({_URL}, '/')
       WHEN o_orderkey % 3 = 1 THEN concat({_URL}, '?utm_source=x') ELSE {_URL} END AS url_raw,
  cast(1 + o_orderkey % 12 AS int) AS search_rank,
  CASE o_orderkey % 4 WHEN 0 THEN 'Adult coed league' WHEN 1 THEN 'Youth academy'
       WHEN 2 THEN 'Register for the season' ELSE 'News article' END AS page_title,
  CASE o_orderkey % 7 WHEN 0 THEN 'mens rec nights' WHEN 1 THEN 'u12 and up' WHEN 2 THEN 'box office open'
       WHEN 3 THEN 'social club' ELSE '' END AS page_snippet,
  cast(o_orderdate AS date) AS found_on
FROM {{orders}}""",
    "venues": """
SELECT s_suppkey AS venue_id, concat('Venue ', s_suppkey % 40) AS venue_name,
  CASE WHEN s_suppkey % 6 = 0 THEN null ELSE concat('Club ', s_suppkey) END AS google_name,
  CASE WHEN s_suppkey % 9 = 0 THEN null
       ELSE concat(s_suppkey, ' Main St, Town ', n_name, ', ',
                   CASE s_suppkey % 3 WHEN 0 THEN 'ON' WHEN 1 THEN 'QC' ELSE 'BC' END, ' A1B 2C3, Canada') END AS address,
  CASE WHEN s_suppkey % 5 = 0 THEN null ELSE cast(43 + s_suppkey % 7 AS double) END AS lat,
  CASE WHEN s_suppkey % 11 = 0 THEN null ELSE concat('place-', s_suppkey) END AS google_place_id,
  cast(s_suppkey % 101 AS int) AS confidence_score,
  s_suppkey % 4 = 0 AS manually_verified,
  CASE s_suppkey % 4 WHEN 0 THEN 'Indoor' WHEN 1 THEN 'Outdoor' WHEN 2 THEN 'Swamp' ELSE null END AS court_type_broad,
  cast(s_suppkey % 90 AS int) AS court_type_broad_conf,
  CASE s_suppkey % 3 WHEN 0 THEN 'Turf Field' WHEN 1 THEN 'Ice Rink' ELSE 'Roof' END AS court_type_specific,
  cast(s_suppkey % 80 AS int) AS court_type_specific_conf
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "site_links": """
SELECT s AS site_id, i AS position, source_url, discovered_url, anchor_text FROM (
  SELECT o_orderkey // 200 AS s, o_orderkey % 200 AS i,
    CASE WHEN (o_orderkey % 200 - 1) // 4 = 0 THEN concat('https://www.site-', o_orderkey // 200, '.com/')
         ELSE concat('https://site-', o_orderkey // 200, '.com/n', (o_orderkey % 200 - 1) // 4) END AS source_url,
    concat('https://site-', o_orderkey // 200, '.com/n', o_orderkey % 200) AS discovered_url,
    CASE o_orderkey % 13 WHEN 0 THEN 'Register Now' WHEN 1 THEN 'Schedule' WHEN 2 THEN 'Standings and teams' WHEN 3 THEN 'Learn more'
      WHEN 4 THEN 'Youth camp league' WHEN 5 THEN 'About us' WHEN 6 THEN 'Volleyball' WHEN 7 THEN 'Team rules'
      WHEN 8 THEN 'Contact' WHEN 9 THEN 'Pricing and fees' WHEN 10 THEN 'Gym location' WHEN 11 THEN 'Kids swim'
      ELSE 'Current season' END AS anchor_text
  FROM {orders} WHERE o_orderkey % 200 > 0
  UNION ALL
  SELECT o_orderkey // 200, 0, concat('https://site-', o_orderkey // 200, '.com/n', o_orderkey % 200),
    CASE o_orderkey % 5 WHEN 0 THEN concat('https://www.site-', o_orderkey // 200, '.com/')
      WHEN 1 THEN concat('https://www.facebook.com/site', o_orderkey // 200)
      WHEN 2 THEN concat('https://site-', o_orderkey // 200, '.com/login?next=schedule')
      WHEN 3 THEN concat('https://site-', o_orderkey // 200, '.com/rules.pdf')
      ELSE concat('https://shop.site-', o_orderkey // 200, '.com/cart') END,
    CASE o_orderkey % 5 WHEN 0 THEN 'Home' WHEN 1 THEN 'Our league on social' WHEN 2 THEN 'Login' WHEN 3 THEN 'Rules' ELSE 'Cart' END
  FROM {orders} WHERE o_orderkey % 200 > 0
  UNION ALL
  SELECT o_orderkey // 200, 900, concat('https://www.site-', o_orderkey // 200, '.com/'),
    concat('https://site-', o_orderkey // 200, '.com/login/map'), 'League venue'
  FROM {orders} WHERE o_orderkey % 200 = 0)""",
    "site_pages": """
SELECT o_orderkey // 200 AS site_id,
  CASE WHEN o_orderkey % 200 = 0 THEN concat('https://www.site-', o_orderkey // 200, '.com/')
       ELSE concat('https://site-', o_orderkey // 200, '.com/n', o_orderkey % 200) END AS url,
  CASE o_orderkey % 7 WHEN 0 THEN 'LEAGUE_INDEX' WHEN 1 THEN 'LEAGUE_DETAIL' WHEN 2 THEN 'SCHEDULE' WHEN 3 THEN 'MEDIUM_DETAIL'
       WHEN 4 THEN 'LEAGUE_INDEX' ELSE 'OTHER' END AS page_type
FROM {orders}""",
    "snapshots": """
SELECT page_id AS snapshot_id, url, html AS content,
  date '2000-06-30' - cast(page_id % 30 AS int) AS created_at,
  CASE page_id % 3 WHEN 0 THEN 'multi_page_selenium' WHEN 1 THEN 'single_page_selenium' ELSE 'http' END AS fetch_method,
  cast(page_id % 4 AS int) AS pages_visited
FROM {pages}""",
}

# Only the oracle needs these: in Spark the columns and links come from the operators under test.
ORACLE_VIEWS = {
    "listings_x": """
SELECT l.*, regexp_extract(url_scraped, '://www\\.([^/]+)', 1) AS base_domain,
  CASE WHEN regexp_matches(lower(coalesce(division_name, '')), 'drop.?in|pick.?up|one.?time|casual|social night|open play') THEN 'drop_in'
       WHEN coalesce(num_weeks, 0) <= 1 AND coalesce(individual_fee, 99) < 20 THEN 'drop_in'
       WHEN coalesce(num_weeks, 0) >= 4 OR coalesce(team_fee, 0) > 0 THEN 'league' ELSE 'unknown' END AS listing_type,
  CASE source_comp_level WHEN 'Competitive' THEN 'A' WHEN 'High Intermediate' THEN 'B+'
       WHEN 'rec/intermediate' THEN 'B+' WHEN 'Novice' THEN 'D' ELSE 'A' END AS standardized_comp_level
FROM listings l""",
    "active": """
SELECT * FROM listings_x WHERE NOT is_archived AND listing_type = 'league'""",
    "anchors": """
SELECT page_id, url AS source_url, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS anchor_text,
  unnest(range(len(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)))) AS position
FROM pages""",
    "links": """
SELECT page_id, position, source_url, trim(anchor_text) AS anchor_text,
  concat(regexp_extract(source_url, '^(https?://[^/?#]*)', 1), href) AS discovered_url
FROM anchors WHERE href LIKE '/%'""",
}
NEEDS = {"listings_x": ("listings",), "active": ("listings_x",), "links": ("anchors",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the given tables."""
    sql = VIEWS[name]
    sql = re.sub(r"(\([^()]*\)|\w+) // (\d+)", r"div(\1, \2)", sql)
    given = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **given)


def with_views(sql: str, *names: str) -> str:
    """The oracle query with the views it needs as WITH clauses."""
    ordered: list[str] = []
    start = "WITH RECURSIVE " if "RECURSIVE" in names else "WITH "
    names = tuple(n for n in names if n != "RECURSIVE")

    def add(n):
        for d in NEEDS.get(n, ()):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    parts = []
    for n in ordered:
        body = VIEWS.get(n) or ORACLE_VIEWS[n]
        if n in VIEWS:
            body = re.sub(r"\{(\w+)\}", r"\1", body)
        parts.append(f"{n} AS ({body})")
    sql = sql.strip()
    if parts and sql.upper().startswith("WITH "):
        return start + ",\n".join(parts) + ",\n" + sql[5:]
    return (start + ",\n".join(parts) + "\n" + sql) if parts else sql

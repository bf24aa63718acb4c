"""Queries over sources, sinks, vector search, set operations and traversal."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, urls
from ..operators import crawl, filters, similar, vectors
from ..session import shared_folder
from ..sources import responses, tables
from .registry import query
from .sql_parts import RATIO_SQL
from . import table_functions
from .report_queries import CATEGORY_SQL, DOMAIN_CITY_SQL, SITE_NAV_SQL, checks_with_status
from .page_queries import TEXT_SQL
from .scoring_queries import STATUS_SQL

_DOMAIN = "array_to_string(string_split(regexp_extract({0}, '://([^/?#]*)', 1), '.')[-2:], '.')"


def scratch(t, name: str) -> str:
    return os.path.join(shared_folder(t.spark), f"{name}-{uuid.uuid4()}")


@query("s2_csv_round_trip", """
SELECT league_id, organization_name, day_of_week, team_fee, cast(NULL AS varchar) AS end_time FROM listings""", ("listings",))
def _(t):
    path = scratch(t, "csv")
    tables.write_csv(t.listings, path, ["league_id", "organization_name", "day_of_week", "team_fee", "end_time"])
    return tables.read_csv(t.spark, path, "league_id bigint, organization_name string, day_of_week string, team_fee decimal(12,2), end_time string")


@query("s3_append_snapshots", f"""
SELECT url, {_DOMAIN.format('url')} AS domain, octet_length(encode(content)) AS size_bytes, length(content) // 4 AS token_estimate,
  'pending' AS extraction_status, cast(created_at AS varchar) AS fetch_time, created_at AS fetch_day FROM snapshots""", ("snapshots",))
def _(t):
    path = scratch(t, "snapshots")
    tables.append(tables.snapshot_rows(t.snapshots, F.col("created_at")), path, "fetch_day")
    back = t.spark.read.parquet(path)
    return back.select("url", "domain", "size_bytes", "token_estimate", "extraction_status", F.col("metadata")["fetch_time"].alias("fetch_time"), "fetch_day")


@query("s4_snapshots_of_domain", f"""
SELECT snapshot_id, url, created_at FROM snapshots WHERE {_DOMAIN.format('url')} = 'example.com'""", ("snapshots",))
def _(t):
    df = t.snapshots.withColumn("domain", urls.base_domain(F.col("url")))
    return tables.snapshots_of(df, domain="example.com").select("snapshot_id", "url", "created_at")


@query("s4_snapshots_of_url", """
SELECT snapshot_id, created_at FROM snapshots WHERE url = 'https://m.ththth.example.net/en/25#top'""", ("snapshots",))
def _(t):
    return tables.snapshots_of(t.snapshots, url="https://m.ththth.example.net/en/25#top").select("snapshot_id", "created_at")


@query("s5_search_responses", """
SELECT result_id, url_raw, page_title, page_snippet, search_rank FROM results
UNION ALL SELECT result_id, 'https://second.org', 'Second', '', search_rank + 1 FROM results""", ("results",))
def _(t):
    entry = lambda link, pos, title, snippet: F.struct(link.alias("link"), pos.alias("position"), title.alias("title"), snippet.alias("snippet"))
    none = F.lit(None).cast("string")
    organic = F.array(entry(F.col("url_raw"), F.col("search_rank") - 1, F.col("page_title"), F.col("page_snippet")),
                      entry(none, F.col("search_rank"), F.lit("no link"), none),
                      entry(F.lit("https://second.org"), F.col("search_rank"), F.lit("Second"), none),
                      entry(F.lit("https://third.org"), F.lit(None).cast("int"), F.lit("no rank"), none))
    text = F.to_json(F.struct(organic.alias("organic"), F.lit(1).alias("credits")))
    return responses.search_results(t.results.withColumn("response", text), "response", ["result_id"])


@query("s6_places_responses", """
SELECT venue_id, google_place_id AS place_id, google_name AS name, address AS formatted_address, lat, -75.5::double AS lng, 'park,gym' AS types,
  venue_id % 7 AS user_ratings_total FROM venues""", ("venues",))
def _(t):
    location = F.struct(F.struct("lat", F.lit(-75.5).alias("lng")).alias("location"))
    place = F.struct(F.col("google_place_id").alias("place_id"), F.col("google_name").alias("name"), F.col("address").alias("formatted_address"),
                     location.alias("geometry"), F.array(F.lit("park"), F.lit("gym")).alias("types"), (F.col("venue_id") % 7).alias("user_ratings_total"))
    other = F.struct(F.lit("x").alias("place_id"), F.lit("Other").alias("name"), F.lit("y").alias("formatted_address"), location.alias("geometry"),
                     F.array(F.lit("cafe")).alias("types"), F.lit(1).cast("bigint").alias("user_ratings_total"))
    text = F.to_json(F.struct(F.array(place, other).alias("results"), F.lit("OK").alias("status")))
    out = responses.first_place(t.venues.withColumn("response", text), "response", ["venue_id"])
    return out.withColumn("types", F.array_join("types", ","))


@query("s7_extraction_responses", """
SELECT o_orderkey, 'Club ' || o_custkey AS organization_name, (o_orderkey % 12)::int AS num_weeks FROM orders
UNION ALL SELECT o_orderkey, 'Second', 3 FROM orders WHERE o_orderkey % 5 IN (0, 1, 4)""")
def _(t):
    k = F.col("o_orderkey")
    one = F.concat(F.lit('{"organization_name": "Club '), F.col("o_custkey").cast("string"), F.lit('", "num_weeks": '), (k % 12).cast("string"), F.lit("}"))
    two = F.lit('{"organization_name": "Second", "num_weeks": 3}')
    both = F.concat(F.lit('{"leagues": [\n'), one, F.lit(", "), two, F.lit("]}"))
    text = (F.when(k % 5 == 0, both).when(k % 5 == 1, F.concat(F.lit("Here you are:\n```json\n"), both, F.lit("\n```")))
            .when(k % 5 == 2, F.concat(F.lit('{"leagues": [\n'), one, F.lit(', {"organization_name": "Cut off, {}')))
            .when(k % 5 == 3, F.concat(F.lit('{"leagues": '), one, F.lit("}")))
            .otherwise(F.concat(F.lit("```json\n["), one, F.lit(","), two, F.lit("]\n```"))))
    df = t.table("orders").select(k, text.alias("response"))
    return responses.extracted_records(df, "response", "organization_name string, num_weeks int", ["o_orderkey"])


@query("s8_append_links", """
SELECT site_id, position, discovered_url, 'site-' || site_id || '.com' AS base_domain FROM site_links""", ("site_links",))
def _(t):
    path = scratch(t, "links")
    tables.append(tables.link_rows(t.site_links), path)
    return t.spark.read.parquet(path).select("site_id", "position", "discovered_url", "base_domain")


@query("s9_append_checks", f"""
SELECT check_id, check_run_id, league_id, old_num_teams, new_num_teams, division_name, {STATUS_SQL} AS status FROM checks""", ("checks",))
def _(t):
    path = scratch(t, "checks")
    tables.append(tables.check_rows(checks_with_status(t)), path)
    return t.spark.read.parquet(path)


@query("s10_review_rows", """
SELECT url_scraped AS url, league_id AS existing_league_id, 'num_teams' AS reason, 'PENDING' AS status, league_id AS json_id, organization_name AS json_org,
  day_of_week AS json_day FROM listings""", ("listings",))
def _(t):
    rows = tables.review_rows(t.listings, F.col("league_id"), F.lit("num_teams"))
    j = lambda f: F.get_json_object("extracted", f"$.{f}")
    return rows.select("url", "existing_league_id", "reason", "status", j("league_id").cast("bigint").alias("json_id"),
                       j("organization_name").alias("json_org"), j("day_of_week").alias("json_day"))


@query("s12_detail_rows", """
SELECT url_scraped || '/schedule' AS url, url_scraped AS parent_url, 'SCHEDULE' AS page_type, q.scrape_id, 'PENDING' AS status
FROM listings LEFT JOIN (SELECT url, min(scrape_id) AS scrape_id FROM queue WHERE status = 'PENDING' GROUP BY url) q ON q.url = url_scraped""", ("listings", "queue"))
def _(t):
    u = F.col("url_scraped")
    links = t.listings.select(F.concat(u, F.lit("/schedule")).alias("url"), u.alias("parent_url"), F.lit("SCHEDULE").alias("page_type"))
    return tables.detail_rows(links, t.queue.filter("status = 'PENDING'"))


@query("t1_domain_audit", """
SELECT 'pages' AS table_name, count(*) AS row_count, count(*) FILTER (len(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')) > 2) AS not_normalized FROM pages
UNION ALL SELECT 'listings', count(*), count(*) FROM listings UNION ALL SELECT 'queue', count(*), 0 FROM queue
UNION ALL SELECT 'links', count(*), count(*) FILTER (contains(discovered_url, 'www.') OR contains(discovered_url, 'shop.')) FROM site_links""", ("listings", "queue", "site_links"))
def _(t):
    host = lambda df, c: df.select(urls.host(F.col(c)).alias("domain"))
    return tables.domain_audit({
        "pages": (host(t.table("pages"), "url"), "domain"), "listings": (host(t.listings, "url_scraped"), "domain"),
        "queue": (t.queue.select(urls.base_domain(F.col("url")).alias("domain")), "domain"), "links": (host(t.site_links, "discovered_url"), "domain")})


@query("t2_field_sets", "SELECT league_id, concat_ws(',', " + ", ".join(
    f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in fv.COVERAGE_FIELDS) + ") AS covered, " + " + ".join(
    f"({f} IS NULL)::int" for f in fv.COVERAGE_FIELDS) + " AS missing FROM listings", ("listings",))
def _(t):
    df = t.listings
    missing = filters.missing_fields(df, fv.COVERAGE_FIELDS)
    every = F.array(*[F.lit(f) for f in fv.COVERAGE_FIELDS])
    covered = F.array_except(every, missing)
    return df.select("league_id", F.array_join(covered, ",").alias("covered"),
                     (F.size(F.array_union(covered, missing)) - F.size(covered)).alias("missing"))


@query("t3_without_home_links", """
SELECT site_id, position, discovered_url FROM site_links l WHERE source_url NOT LIKE 'https://www.%' AND NOT EXISTS (
  SELECT 1 FROM site_links h WHERE h.site_id = l.site_id AND h.source_url LIKE 'https://www.%' AND h.discovered_url = l.discovered_url)""", ("site_links",))
def _(t):
    at_home = F.col("source_url").startswith("https://www.")
    return crawl.without_home_links(t.site_links.filter(~at_home), t.site_links.filter(at_home)).select("site_id", "position", "discovered_url")


def query_vector(df):
    """The vector to search for: that of the least id (one row)."""
    return [float(x) for x in df.orderBy("vec_id").select("embedding").first()[0]]


@query("e1_similar_vectors", """
SELECT vec_id, label, round(cosine, 4) AS similarity FROM (
  SELECT vec_id, label, list_cosine_similarity(embedding::double[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::double[]) AS cosine FROM embeddings)
WHERE cosine > 0.1 ORDER BY cosine DESC, vec_id LIMIT 20""")
def _(t):
    df = t.table("embeddings")
    return vectors.similar(df, query_vector(df), 20, 0.1).withColumn("similarity", F.round("similarity", 4))


@query("e1_similar_to_each", """
WITH q AS (SELECT CASE WHEN vec_id = (SELECT min(vec_id) FROM embeddings) THEN 'first' ELSE 'last' END AS query, embedding::double[] AS v FROM embeddings
  WHERE vec_id IN ((SELECT min(vec_id) FROM embeddings), (SELECT max(vec_id) FROM embeddings))),
s AS (SELECT query, vec_id, list_cosine_similarity(embedding::double[], v) AS sim FROM embeddings, q)
SELECT query, vec_id, round(sim, 4) AS similarity, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim > 0 QUALIFY rank <= 10""")
def _(t):
    df = t.table("embeddings")
    last = [float(x) for x in df.orderBy(F.desc("vec_id")).select("embedding").first()[0]]
    return vectors.similar_to_each(df, {"first": query_vector(df), "last": last}, 10).withColumn("similarity", F.round("similarity", 4))


@query("e2_page_pieces", f"""
SELECT page_id, {TEXT_SQL} AS content, left({TEXT_SQL}, 8000) AS embed_text, 'home' AS page_type, url AS source_url FROM pages""")
def _(t):
    out = vectors.page_pieces(t.table("pages"), F.lit("home"), F.create_map(F.lit("scraped"), F.lit("2000-06-30")))
    m = F.col("metadata")
    return out.select("page_id", "content", "embed_text", m["page_type"].alias("page_type"), m["source_url"].alias("source_url"))


@query("e3_text_pieces", """
WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS words FROM documents),
n AS (SELECT *, greatest(1, (len(words) + 999) // 1000) AS n FROM w), s AS (SELECT *, (len(words) + n - 1) // n AS size FROM n),
p AS (SELECT *, unnest(range(n)) AS piece FROM s)
SELECT doc_id, piece, array_to_string(words[piece * size + 1 : (piece + 1) * size], ' ') AS piece_text FROM p
WHERE array_to_string(words[piece * size + 1 : (piece + 1) * size], ' ') <> ''""")
def _(t):
    return vectors.text_pieces(t.table("documents"), "text", ["doc_id"])


def starts(t):
    return t.site_pages.filter(F.col("url").startswith("https://www.")).select(F.col("url").alias("start_url"))


CRAWL_SQL = f"""
{SITE_NAV_SQL.strip()},
norm AS (SELECT site_id, position, replace(source_url, '://www.', '://') AS parent, replace(discovered_url, '://www.', '://') AS url, score FROM nav
  WHERE NOT suffix(discovered_url, '.pdf')),
typed AS (SELECT site_id, replace(url, '://www.', '://') AS url, page_type FROM site_pages),
root AS (SELECT site_id, replace(url, '://www.', '://') AS start FROM site_pages WHERE url LIKE 'https://www.%'),
home AS (SELECT n.site_id, n.url FROM norm n JOIN root r ON n.parent = r.start AND n.site_id = r.site_id),
step AS (SELECT r.start, n.url, n.parent, n.score, coalesce(t.page_type, 'OTHER') AS page_type, n.site_id
  FROM norm n JOIN root r ON n.parent = r.start AND n.site_id = r.site_id LEFT JOIN typed t ON t.url = n.url WHERE n.score >= 100 AND n.url <> r.start),
edge AS (SELECT n.site_id, n.parent, n.url, n.score, n.position, coalesce(t.page_type, 'OTHER') AS page_type FROM norm n LEFT JOIN typed t ON t.url = n.url
  WHERE contains(n.url, concat('site-', n.site_id, '.com')) AND n.score >= 0 AND NOT EXISTS (SELECT 1 FROM home h WHERE h.site_id = n.site_id AND h.url = n.url)
    AND n.url NOT IN (SELECT start FROM root)),
l1 AS (SELECT start, site_id, url, min(parent) AS parent, max(score) AS score, min(page_type) AS page_type, 1 AS depth,
    CASE WHEN min(page_type) IN ('SCHEDULE', 'MEDIUM_DETAIL') THEN 'defer' ELSE 'collect' END AS action FROM step GROUP BY 1, 2, 3),
f1 AS (SELECT *, action = 'collect' AS follow FROM l1),
l2 AS (SELECT f.start, e.site_id, e.url, e.parent, e.score, e.page_type, 2 AS depth,
    CASE WHEN e.page_type IN ('SCHEDULE', 'MEDIUM_DETAIL') THEN 'defer' WHEN e.page_type = 'OTHER' AND e.score < 100 THEN 'skip' WHEN e.score < 50 THEN 'skip' ELSE 'collect' END AS action
  FROM f1 f JOIN edge e ON e.parent = f.url AND e.site_id = f.site_id WHERE f.follow AND e.url NOT IN (SELECT url FROM l1)
  QUALIFY row_number() OVER (PARTITION BY f.start, e.url ORDER BY e.parent, e.position) = 1),
f2 AS (SELECT *, action = 'collect' AND (page_type IN ('LEAGUE_INDEX', 'OTHER') OR score >= 100) AS follow FROM l2),
l3 AS (SELECT f.start, e.site_id, e.url, e.parent, e.score, e.page_type, 3 AS depth,
    CASE WHEN e.page_type IN ('SCHEDULE', 'MEDIUM_DETAIL') THEN 'defer' WHEN e.page_type = 'OTHER' AND e.score < 100 THEN 'skip' WHEN e.score < 50 THEN 'skip' ELSE 'collect' END AS action
  FROM f2 f JOIN edge e ON e.parent = f.url AND e.site_id = f.site_id WHERE f.follow AND e.url NOT IN (SELECT url FROM l1 UNION ALL SELECT url FROM l2)
  QUALIFY row_number() OVER (PARTITION BY f.start, e.url ORDER BY e.parent, e.position) = 1),
reached AS (SELECT start, start AS url, NULL AS parent, 0 AS depth, NULL AS score, 'collect' AS action FROM root
  UNION ALL SELECT start, url, parent, depth, score, action FROM l1 UNION ALL SELECT start, url, parent, depth, score, action FROM l2
  UNION ALL SELECT start, url, parent, depth, score, action FROM l3)"""


@query("g1_crawl", f"WITH {CRAWL_SQL} SELECT * FROM reached", ("site_links", "site_pages"))
def _(t):
    return crawl.crawl(starts(t), t.site_links, t.site_pages).select("start", "url", "parent", "depth", "score", "action")


@query("g2_extra_pages", f"""
WITH {CRAWL_SQL}, {CATEGORY_SQL},
on_home AS (SELECT r.start, c.site_id, replace(c.discovered_url, '://www.', '://') AS url, c.position, c.field_category, n.score,
    CASE WHEN regexp_matches(c.t, 'schedule|standings|teams|results|scores|matchups|upcoming') THEN 'SCHEDULE'
      WHEN regexp_matches(c.t, 'register|signup|sign up|enroll|payment|fees|pricing|cost') THEN 'REGISTRATION'
      WHEN regexp_matches(c.t, 'rules|policies|insurance|waiver|referee|format') THEN 'POLICY'
      WHEN regexp_matches(c.t, 'venue|location|facility|field|gym|arena|court') THEN 'VENUE'
      WHEN regexp_matches(c.t, 'league|division|program|season|current|calendar|about|sport|join|enroll|upcoming|more info|volleyball|social') THEN 'DETAIL' END AS by_text
  FROM cat c JOIN nav n USING (site_id, position, source_url, discovered_url, anchor_text) JOIN root r ON r.site_id = c.site_id AND r.start = replace(c.source_url, '://www.', '://')
  WHERE NOT suffix(c.discovered_url, '.pdf')),
used AS (SELECT DISTINCT start, by_text FROM on_home WHERE score >= 100 AND url <> start AND by_text IS NOT NULL)
SELECT start, field_category, url, score, row_number() OVER (PARTITION BY start, field_category ORDER BY score DESC, position, url) AS rank FROM (
  SELECT * FROM on_home o WHERE score >= 50 AND field_category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM used u WHERE u.start = o.start AND u.by_text = o.field_category)
    AND (start, url) NOT IN (SELECT (start, url) FROM reached)
  QUALIFY row_number() OVER (PARTITION BY start, field_category, url ORDER BY score DESC, position) = 1) QUALIFY rank <= 3""", ("site_links", "site_pages"))
def _(t):
    reached = crawl.crawl(starts(t), t.site_links, t.site_pages)
    return crawl.extra_pages(starts(t), t.site_links, reached, lower_score=50)


@query("g3_parent_map", f"""
WITH {CRAWL_SQL} SELECT url AS child_url, parent AS parent_url FROM (SELECT * FROM l2 UNION ALL SELECT * FROM l3)
WHERE action = 'collect' AND page_type IN ('LEAGUE_INDEX', 'LEAGUE_DETAIL')""", ("site_links", "site_pages"))
def _(t):
    return crawl.parent_map(crawl.crawl(starts(t), t.site_links, t.site_pages))


@query("u1_latest_checks_view", f"""
SELECT league_id, checked_at, new_num_teams, {STATUS_SQL} AS status FROM checks
QUALIFY row_number() OVER (PARTITION BY league_id ORDER BY checked_at DESC, check_id) = 1""", ("checks",))
def _(t):
    table_functions.register_views(t.spark, t.listings, checks_with_status(t), t.results, t.queries)
    return t.spark.sql("SELECT league_id, checked_at, new_num_teams, status FROM latest_league_checks")


@query("u2_check_age_view", f"""
SELECT count(*) AS urls, count(last_checked_at) AS checked, sum(league_count)::bigint AS listings FROM (
  SELECT url_scraped, organization_name, count(DISTINCT l.league_id) AS league_count, max(checked_at) AS last_checked_at
  FROM listings l LEFT JOIN checks c USING (league_id) WHERE NOT is_archived GROUP BY ALL)""", ("listings", "checks"))
def _(t):
    table_functions.register_views(t.spark, t.listings, checks_with_status(t), t.results, t.queries)
    return t.spark.sql("SELECT count(*) AS urls, count(last_checked_at) AS checked, sum(league_count) AS listings FROM urls_with_check_age")


@query("u3_match_vectors", """
SELECT vec_id, round(s, 4) AS similarity FROM (SELECT vec_id, list_cosine_similarity(embedding::double[],
  (SELECT embedding FROM embeddings ORDER BY vec_id DESC LIMIT 1)::double[]) AS s FROM embeddings) WHERE s > 0.2 ORDER BY s DESC, vec_id LIMIT 5""")
def _(t):
    df = t.table("embeddings")
    last = [float(x) for x in df.orderBy(F.desc("vec_id")).select("embedding").first()[0]]
    return table_functions.match_league_vectors(df, last, 5, 0.2).select("vec_id", F.round("similarity", 4).alias("similarity"))


@query("u4_domain_city_view", DOMAIN_CITY_SQL, ("results", "queries"))
def _(t):
    table_functions.register_views(t.spark, t.listings, checks_with_status(t), t.results, t.queries)
    return t.spark.sql("SELECT domain, city FROM domain_city_map")


@query("t4_sorted_page", """
SELECT league_id, quality_score FROM listings ORDER BY quality_score DESC, league_id LIMIT 100 OFFSET 50""", ("listings",))
def _(t):
    return t.listings.orderBy(F.desc("quality_score"), "league_id").offset(50).limit(100).select("league_id", "quality_score")


@query("u5_similarity_ratio", f"""
WITH pairs AS (SELECT coalesce(venue_name, '') AS a, coalesce(google_name, '') AS b FROM venues), {RATIO_SQL}
SELECT venue_id, round(ratio, 6) AS ratio FROM venues JOIN ratios ON a = coalesce(venue_name, '') AND b = coalesce(google_name, '')""", ("RECURSIVE", "venues"))
def _(t):
    """Similarity of each venue's name and the name it was found under, compared once for each distinct pair."""
    named = t.venues.select("venue_id", *[F.coalesce(c, F.lit("")).alias(n) for c, n in (("venue_name", "a"), ("google_name", "b"))])
    return named.join(similar.ratios(named), ["a", "b"]).select("venue_id", F.round("ratio", 6).alias("ratio"))


@query("u5_similar_names", f"""
WITH pairs AS (SELECT a.name AS a, b.name AS b FROM (SELECT DISTINCT venue_name AS name FROM venues) a, (SELECT DISTINCT google_name AS name FROM venues) b WHERE b.name IS NOT NULL), {RATIO_SQL}
SELECT a, b, round(ratio, 6) AS ratio FROM ratios WHERE ratio >= 0.35""", ("RECURSIVE", "venues"))
def _(t):
    """All venue names and found names that read alike, whichever venues they belong to."""
    found = similar.similar_pairs(t.venues.select("venue_name"), t.venues.select("google_name"), 0.35)
    return found.select("a", "b", F.round("ratio", 6).alias("ratio"))

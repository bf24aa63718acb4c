"""Queries over inserts, updates, deletes and duplicate handling."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, IntegerType, LongType, StringType, StructField, StructType

from .. import schemas
from ..functions import scoring, urls
from ..operators import changes, dedupe, joins
from ..session import settle
from .fixtures import SPLIT_DAY
from .join_queries import SAME_DAY_SQL, match_sql, page_parents
from .merge_queries import _SHOWN, merged_sql
from .registry import query
from .report_queries import DOMAIN_CITY_SQL, checks_with_status
from .scoring_queries import NINE_COUNT, SCORE_SQL, STATUS_SQL, as_of
from .sql_parts import CASE_CITY

PLAN_SQL = f"""
plan AS (SELECT l.league_id, CASE WHEN sport_name IS NULL AND sport_season_code IS NULL THEN 'INVALID' WHEN b.match_id IS NOT NULL THEN 'MERGE'
    WHEN {NINE_COUNT} * 100.0 / 9 >= 50 THEN 'INSERT' ELSE 'REJECT_QUALITY' END AS action,
    CASE WHEN sport_name IS NOT NULL OR sport_season_code IS NOT NULL THEN b.match_id END AS match_id
  FROM listings_x l LEFT JOIN best b USING (league_id) WHERE updated_at >= date '{SPLIT_DAY}')"""


@query("m1_insert_plan", f"WITH {match_sql(3)}, {PLAN_SQL} SELECT * FROM plan", ("listings_x",))
def _(t):
    return changes.insert_plan(t.incoming, t.stored).select("league_id", "action", "match_id")


@query("m1_apply_insert_plan", f"""
WITH {match_sql(3)}, {PLAN_SQL}, to_merge AS (SELECT * FROM plan WHERE action = 'MERGE'), {merged_sql("to_merge")}
SELECT league_id, {', '.join(_SHOWN)}, {SCORE_SQL} AS quality_score FROM merged
UNION ALL SELECT league_id, {', '.join(_SHOWN)}, quality_score FROM listings_x WHERE updated_at < date '{SPLIT_DAY}' AND league_id NOT IN (SELECT league_id FROM merged)
UNION ALL SELECT league_id, {', '.join(_SHOWN)}, quality_score FROM listings_x WHERE league_id IN (SELECT league_id FROM plan WHERE action = 'INSERT')""", ("listings_x",))
def _(t):
    plan = changes.insert_plan(t.incoming, t.stored)
    return changes.apply_insert_plan(t.incoming, t.stored, plan, as_of()).select("league_id", *_SHOWN, "quality_score")


def raw_listings(t):
    """Listings as an extraction would deliver them: everything as text."""
    return t.listings.select(*[F.col(c).cast("string").alias(c) for c in t.listings.columns])


@query("m2_prepare", f"""
SELECT cast(league_id AS varchar) AS league_id, team_fee::double AS team_fee, num_teams, num_weeks, has_referee, requires_insurance,
  time_played_per_week || ' minutes' AS time_played_per_week, base_domain, listing_type, {SCORE_SQL} AS quality_score, false AS is_archived,
  coalesce(greatest(year(season_start_date), year(season_end_date)), year(season_start_date), year(season_end_date), season_year) AS season_year
FROM listings_x""", ("listings_x",))
def _(t):
    return changes.prepare(raw_listings(t), as_of(), [
        "league_id", "team_fee", "num_teams", "num_weeks", "has_referee", "requires_insurance", "time_played_per_week",
        "base_domain", "listing_type", "quality_score", "is_archived", "season_year"]).withColumn("season_year", F.col("season_year").cast("int"))


@query("m2_conform", """
SELECT league_id, organization_name, num_weeks, team_fee, season_start_date, is_archived, cast(NULL AS varchar) AS end_time FROM listings""", ("listings",))
def _(t):
    schema = StructType([StructField("league_id", LongType()), StructField("organization_name", StringType()), StructField("num_weeks", IntegerType()),
                         StructField("team_fee", DecimalType(12, 2)), StructField("season_start_date", DateType()),
                         StructField("is_archived", BooleanType()), StructField("end_time", StringType())])
    return changes.conform(raw_listings(t), schema)


@query("m2_conform_to_listing", """
SELECT league_id, organization_name, num_teams, cast(team_fee AS decimal(10,2)) AS team_fee, season_end_date, has_referee, cast(NULL AS varchar) AS end_time,
  is_archived FROM listings""", ("listings",))
def _(t):
    return changes.conform(raw_listings(t), schemas.LISTING).select(
        "league_id", "organization_name", "num_teams", "team_fee", "season_end_date", "has_referee", "end_time", "is_archived")


@query("m3_set_status_by_filter", """
SELECT scrape_id, CASE WHEN status = 'FAILED' AND (url ILIKE '%ottawa%' OR organization_name ILIKE '%ottawa%') THEN 'PENDING' ELSE status END AS status,
  status = 'FAILED' AND (url ILIKE '%ottawa%' OR coalesce(organization_name, '') ILIKE '%ottawa%') AS changed FROM queue""", ("queue",))
def _(t):
    return changes.set_status_by_filter(t.queue, "PENDING", statuses=["FAILED"], search="ottawa").select("scrape_id", "status", "changed")


@query("m3_set_status", """
SELECT scrape_id, CASE WHEN priority = 3 THEN 'SKIPPED' ELSE status END AS status, priority = 3 AS changed FROM queue""", ("queue",))
def _(t):
    return changes.set_status(t.queue, F.col("priority") == 3, "SKIPPED").select("scrape_id", "status", "changed")


@query("m3_archive", """
SELECT league_id, is_archived OR quality_score < 10 AS is_archived FROM listings""", ("listings",))
def _(t):
    return changes.archive(t.listings, t.listings.filter("quality_score < 10")).select("league_id", "is_archived")


@query("m4_finish_runs", """
SELECT scrape_id, CASE WHEN status = 'IN_PROGRESS' THEN 'COMPLETED' ELSE status END AS status,
  CASE WHEN status = 'IN_PROGRESS' THEN coalesce(scrape_attempts, 0) + 1 ELSE scrape_attempts END AS scrape_attempts FROM queue""", ("queue",))
def _(t):
    outcomes = t.queue.filter("status = 'IN_PROGRESS'").select("scrape_id", F.lit("COMPLETED").alias("status"))
    return changes.finish_runs(t.queue, outcomes).select("scrape_id", "status", "scrape_attempts")


@query("m4_repeated_outcomes", """
WITH outcomes AS (SELECT l_orderkey AS scrape_id, count(*) AS n, arg_max(CASE l_returnflag WHEN 'R' THEN 'FAILED' ELSE 'COMPLETED' END, 2 * l_linenumber + (l_returnflag = 'R')::INT) AS last FROM lineitem GROUP BY 1)
SELECT q.scrape_id, coalesce(o.last, q.status) AS status, CASE WHEN o.n IS NULL THEN q.scrape_attempts ELSE coalesce(q.scrape_attempts, 0) + o.n END::INT AS scrape_attempts
FROM queue q LEFT JOIN outcomes o USING (scrape_id)""", ("queue",))
def _(t):
    """Each line of an order is one outcome of the run of that number; the last line gives the status."""
    status = F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("COMPLETED")
    outcomes = t.table("lineitem").select(F.col("l_orderkey").alias("scrape_id"), status.alias("status"), "l_linenumber")
    return changes.finish_runs(t.queue, outcomes, "l_linenumber").select("scrape_id", "status", F.col("scrape_attempts").cast("int").alias("scrape_attempts"))


@query("m5_screen_queue", "SELECT scrape_id, url FROM queue WHERE status <> 'FAILED'", ("queue",))
def _(t):
    left, _ = changes.screen_out(t.queue, t.screened_results, t.queue.filter("status = 'FAILED'"), "sub_page")
    return left.select("scrape_id", "url")


@query("m5_screen_results", """
SELECT result_id, CASE WHEN bad THEN 'FAILED' ELSE 'KEPT' END AS outcome, CASE WHEN bad THEN 'sub_page' END AS reason FROM (
  SELECT result_id, CASE WHEN suffix(url_raw, '/') THEN left(lower(url_raw), length(url_raw) - 1) ELSE replace(lower(url_raw), '?utm_source=x', '') END IN (
    SELECT lower(url) FROM queue WHERE status = 'FAILED') AND NOT contains(url_raw, '.pdf') AS bad FROM results)""", ("results", "queue"))
def _(t):
    failed = t.queue.filter("status = 'FAILED'").withColumn("url", urls.canonicalize_url(F.col("url")))
    base = t.screened_results.withColumns({"validation_status": F.lit("KEPT"), "validation_reason": F.lit(None).cast("string")})
    _, flagged = changes.screen_out(t.queue, base, failed, "sub_page")
    return flagged.select("result_id", F.col("validation_status").alias("outcome"), F.col("validation_reason").alias("reason"))


@query("m6_requeue", """
WITH w AS (SELECT DISTINCT url_scraped AS url FROM listings WHERE quality_score < 20 UNION SELECT DISTINCT url FROM pages)
SELECT coalesce(q.url, w.url) AS url, scrape_id, CASE WHEN w.url IS NOT NULL THEN 'PENDING' ELSE status END AS status, q.url IS NULL AS is_new,
  CASE WHEN w.url IS NOT NULL THEN 'rescrape_trigger' ELSE 'queue' END AS source FROM queue q FULL JOIN w ON q.url = w.url""", ("listings", "queue"))
def _(t):
    wanted = t.listings.filter("quality_score < 20").select(F.col("url_scraped").alias("url")).union(t.table("pages").select("url"))
    return changes.requeue(t.queue, wanted).select("url", "scrape_id", "status", "is_new", "source")


def found_venues(t):
    """Places found for venue names of the customers."""
    k = F.col("c_custkey")
    return t.table("customer").select(
        k.alias("seq"), F.concat(F.when(k % 2 == 0, "VENUE ").otherwise("Hall "), (k % 60).cast("string")).alias("venue_name"),
        F.when(k % 7 != 0, F.concat(F.lit("place-"), (k % 1200).cast("string"))).alias("google_place_id"),
        F.concat(F.lit("Found "), k.cast("string")).alias("google_name"),
        F.concat(k.cast("string"), F.lit(" Elm St, Delta, AB T1T 1T1, Canada")).alias("address"), (k % 100).cast("int").alias("confidence_score"))


FOUND_SQL = """
found AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'VENUE ' ELSE 'Hall ' END || (c_custkey % 60) AS venue_name,
  CASE WHEN c_custkey % 7 <> 0 THEN 'place-' || (c_custkey % 1200) END AS google_place_id FROM customer),
plan AS (SELECT seq, found.venue_name, coalesce(n.venue_id, p.venue_id) AS venue_id,
    CASE WHEN n.venue_id IS NOT NULL THEN 'UPDATE_BY_NAME' WHEN p.venue_id IS NOT NULL THEN 'UPDATE_BY_PLACE' ELSE 'INSERT' END AS action,
    CASE WHEN n.venue_id IS NOT NULL AND p.venue_id <> n.venue_id THEN NULL ELSE google_place_id END AS new_place_id, found.google_place_id
  FROM found LEFT JOIN (SELECT lower(venue_name) AS name, min(venue_id) AS venue_id FROM venues GROUP BY 1) n ON n.name = lower(found.venue_name)
  LEFT JOIN (SELECT google_place_id, min(venue_id) AS venue_id FROM venues WHERE google_place_id IS NOT NULL GROUP BY 1) p USING (google_place_id))"""


@query("m7_venue_upsert_plan", f"WITH {FOUND_SQL} SELECT seq, venue_id, action, new_place_id, 'AB' AS province, 'Delta' AS city FROM plan", ("venues",))
def _(t):
    return changes.venue_upsert_plan(t.venues, found_venues(t)).select("seq", "venue_id", "action", "new_place_id", "province", "city")


def named_once(t):
    """Venues as a table with unique names holds them: the least id of each name."""
    return t.venues.join(t.venues.groupBy(F.lower("venue_name")).agg(F.min("venue_id").alias("venue_id")), "venue_id", "left_semi")


@query("m7_apply_venue_upsert", f"""
WITH stored AS (SELECT * FROM venues WHERE venue_id IN (SELECT min(venue_id) FROM venues GROUP BY lower(venue_name))), {FOUND_SQL.replace("FROM venues ", "FROM stored ").strip()},
named AS (SELECT * FROM plan QUALIFY row_number() OVER (PARTITION BY lower(venue_name) ORDER BY seq DESC) = 1),
last AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY venue_id, CASE WHEN venue_id IS NULL THEN new_place_id END,
    CASE WHEN venue_id IS NULL AND new_place_id IS NULL THEN lower(venue_name) END ORDER BY seq DESC) = 1),
own AS (SELECT * REPLACE (CASE WHEN seq = min(seq) OVER (PARTITION BY new_place_id) THEN new_place_id END AS new_place_id) FROM last)
SELECT v.venue_id, coalesce(l.venue_name, v.venue_name) AS venue_name, coalesce(l.new_place_id, v.google_place_id) AS google_place_id,
  CASE WHEN seq IS NOT NULL THEN 'Found ' || seq ELSE google_name END AS google_name, CASE WHEN seq IS NOT NULL THEN seq || ' Elm St, Delta, AB T1T 1T1, Canada' ELSE address END AS address,
  CASE WHEN seq IS NOT NULL THEN 'AB' END AS province, CASE WHEN seq IS NOT NULL THEN 'Delta' END AS city, CASE WHEN seq IS NOT NULL THEN seq % 100 ELSE confidence_score END AS confidence_score
FROM stored v LEFT JOIN own l ON l.venue_id = v.venue_id
UNION ALL SELECT NULL, venue_name, new_place_id, 'Found ' || seq, seq || ' Elm St, Delta, AB T1T 1T1, Canada', 'AB', 'Delta', seq % 100 FROM own WHERE venue_id IS NULL""", ("venues",))
def _(t):
    stored = named_once(t)
    return changes.apply_venue_upsert(stored, changes.venue_upsert_plan(stored, found_venues(t))).select(
        "venue_id", "venue_name", "google_place_id", "google_name", "address", "province", "city", "confidence_score")


@query("m9_backfill_domain_and_type", """
SELECT league_id, base_domain, CASE WHEN quality_score % 2 = 0 THEN 'league' ELSE listing_type END AS listing_type FROM listings_x
WHERE quality_score < 50 OR (quality_score % 2 = 1 AND listing_type <> 'unknown')""", ("listings_x",))
def _(t):
    before = t.listings_x.withColumns({
        "base_domain": F.when(F.col("quality_score") >= 50, F.col("base_domain")),
        "listing_type": F.when(F.col("quality_score") % 2 == 0, "league").otherwise("unknown")})
    return changes.backfill_domain_and_type(before)


@query("m9_backfill_levels", """
SELECT league_id, coalesce(source_comp_level, 'None Found') AS source_comp_level,
  CASE WHEN source_comp_level IS NULL OR source_comp_level = 'Competitive' THEN 'A' END AS standardized_comp_level FROM listings""", ("listings",))
def _(t):
    return changes.backfill_levels(t.listings.withColumn("standardized_comp_level", F.lit(None).cast("string"))).select(
        "league_id", "source_comp_level", "standardized_comp_level")


@query("m9_backfill_province_and_name", """
SELECT venue_id, CASE WHEN address IS NOT NULL THEN CASE venue_id % 3 WHEN 0 THEN 'ON' WHEN 1 THEN 'QC' ELSE 'BC' END END AS province,
  coalesce(google_name, venue_name || ' raw') AS google_name FROM venues""", ("venues",))
def _(t):
    name = F.concat(F.col("venue_name"), F.lit(" raw"))
    raw = F.to_json(F.struct(F.array(F.struct(name.alias("name"))).alias("results")))
    venues = t.venues.withColumns({"raw_api_response": raw, "province": F.lit(None).cast("string")})
    return changes.backfill_name(changes.backfill_province(venues), "raw_api_response").select("venue_id", "province", "google_name")


@query("m9_changed_cities", """
SELECT league_id, CASE split_part(url_scraped, '/', 4) WHEN 'ottawa' THEN 'Ottawa' WHEN 'north-york-spring' THEN 'North York' ELSE 'Calgary' END AS city
FROM listings WHERE split_part(url_scraped, '/', 4) <> 'leagues'""", ("listings",))
def _(t):
    new = t.listings.select("league_id", urls.city_from_url(F.col("url_scraped")).alias("city"))
    return new.filter("city IS NOT NULL")


@query("m9_backfill_city", f"""
WITH domains AS ({DOMAIN_CITY_SQL})
SELECT league_id, CASE WHEN quality_score < 50 THEN 'Old Town' ELSE coalesce({CASE_CITY}, d.city) END AS city
FROM listings LEFT JOIN domains d ON d.domain = regexp_extract(url_scraped, '://www\\.([^/]+)', 1)""", ("listings", "results", "queries"))
def _(t):
    before = t.listings.withColumn("city", F.when(F.col("quality_score") < 50, "Old Town"))
    found = joins.backfill_city(before, t.screened_results, t.queries)
    return changes.apply_updates(before, found.select("league_id", "city"), "league_id").select("league_id", "city")


@query("m10_rename_domain", """
SELECT league_id, CASE WHEN base_domain = 'org-7.com' THEN 'org-8.com' ELSE base_domain END AS base_domain FROM listings_x""", ("listings_x",))
def _(t):
    return changes.rename_domain(t.listings_x, "org-7.com", "org-8.com").select("league_id", "base_domain")


@query("m10_set_type_of_url", """
SELECT league_id, CASE WHEN url_scraped = 'https://www.org-8.com/ottawa/1' THEN 'drop_in' ELSE listing_type END AS listing_type FROM listings_x""", ("listings_x",))
def _(t):
    return changes.set_type_of_url(t.listings_x, "https://www.org-8.com/ottawa/1", "drop_in").select("league_id", "listing_type")


_DOMAIN = "array_to_string(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[-2:], '.')"


@query("m11_put_reports", f"""
WITH s AS (SELECT snapshot_id, {_DOMAIN} AS domain, fetch_method, row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY created_at DESC, snapshot_id) = 1 AS newest,
    count(*) OVER (PARTITION BY {_DOMAIN}) AS n FROM snapshots)
SELECT snapshot_id, fetch_method AS method, CASE WHEN newest THEN n || ' pages' END AS gap_report FROM s""", ("snapshots",))
def _(t):
    snaps = t.snapshots.select("snapshot_id", "created_at", urls.base_domain(F.col("url")).alias("domain"),
                               F.create_map(F.lit("method"), F.col("fetch_method")).alias("metadata"))
    found = snaps.groupBy("domain").agg(F.concat(F.count("*").cast("string"), F.lit(" pages")).alias("report"))
    m = F.col("metadata")
    return changes.put_reports(snaps, found).select("snapshot_id", m["method"].alias("method"), F.try_element_at(m, F.lit("gap_report")).alias("gap_report"))


@query("m11_repeated_reports", f"""
WITH s AS (SELECT snapshot_id, {_DOMAIN} AS domain, row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY created_at DESC, snapshot_id) = 1 AS newest FROM snapshots),
last AS (SELECT domain, max(snapshot_id) AS n FROM s GROUP BY domain)
SELECT snapshot_id, CASE WHEN newest THEN 'report ' || n END AS gap_report FROM s JOIN last USING (domain)""", ("snapshots",))
def _(t):
    """One report per snapshot, so many of a domain: the last one stays."""
    snaps = t.snapshots.select("snapshot_id", "created_at", urls.base_domain(F.col("url")).alias("domain"), F.expr("cast(null as map<string,string>)").alias("metadata"))
    found = snaps.select("domain", F.concat(F.lit("report "), F.col("snapshot_id")).alias("report"), F.col("snapshot_id").alias("seq"))
    out = changes.put_reports(snaps, found, order="seq")
    return out.select("snapshot_id", F.try_element_at("metadata", F.lit("gap_report")).alias("gap_report"))


@query("m12_repeated_updates", """
WITH last AS (SELECT l_suppkey AS venue_id, arg_max('Line ' || l_orderkey || '-' || l_linenumber, l_orderkey * 10 + l_linenumber) AS address FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)
SELECT venue_id, coalesce(last.address, venues.address) AS address FROM venues LEFT JOIN last USING (venue_id)""", ("venues",))
def _(t):
    """Thousands of updates of one venue: the last order line counts."""
    line = t.table("lineitem").filter("l_suppkey % 2 = 0")
    updates = line.select(F.col("l_suppkey").alias("venue_id"), F.concat_ws("-", F.concat(F.lit("Line "), F.col("l_orderkey")), "l_linenumber").alias("address"),
                          (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return changes.apply_updates(t.venues, updates, "venue_id", "seq").select("venue_id", "address")


@query("m12_update_venues", """
SELECT venue_id, CASE WHEN s_acctbal < 0 THEN 'Corrected ' || venue_id ELSE address END AS address, manually_verified OR s_acctbal < 0 AS manually_verified
FROM venues JOIN supplier ON s_suppkey = venue_id""", ("venues",))
def _(t):
    s = t.table("supplier").filter("s_acctbal < 0")
    updates = s.select(F.col("s_suppkey").alias("venue_id"), F.concat(F.lit("Corrected "), F.col("s_suppkey").cast("string")).alias("address"),
                       F.lit(True).alias("manually_verified"))
    return changes.apply_updates(t.venues, updates, "venue_id").select("venue_id", "address", "manually_verified")


@query("m12_update_court_types", """
SELECT venue_id, CASE WHEN venue_id % 4 < 2 AND court_type_broad IS NOT NULL THEN court_type_broad ELSE 'Unknown' END AS court_type_broad FROM venues""", ("venues",))
def _(t):
    v = scoring.enum_or(F.col("court_type_broad"), F.col("court_type_broad_conf"), ("Indoor", "Outdoor", "Unknown"), "Unknown")
    updates = t.venues.select("venue_id", v["value"].alias("court_type_broad"))
    return changes.apply_updates(t.venues, updates, "venue_id").select("venue_id", "court_type_broad")


@query("m13_delete_vectors", """
SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT DISTINCT quality + toxic FROM labels)""")
def _(t):
    owners = t.table("labels").select((F.col("quality") + F.col("toxic")).alias("label"))
    return changes.delete_of(t.table("embeddings"), owners, "label").select("vec_id", "label")


@query("m13_deleted_counts", """
SELECT label, count(*) AS deleted FROM embeddings WHERE label IN (SELECT DISTINCT quality + toxic FROM labels) GROUP BY label""")
def _(t):
    owners = t.table("labels").select((F.col("quality") + F.col("toxic")).alias("label"))
    return changes.deleted_counts(t.table("embeddings"), owners, "label")


@query("m14_mark_queued", """
SELECT result_id, result_id IN (SELECT source_result_id FROM queue WHERE status = 'PENDING') AS added_to_scrape_queue FROM results""", ("results", "queue"))
def _(t):
    updates = t.queue.filter("status = 'PENDING'").select(F.col("source_result_id").alias("result_id"), F.lit(True).alias("added_to_scrape_queue"))
    return changes.apply_updates(t.results.withColumn("added_to_scrape_queue", F.lit(False)), updates, "result_id").select(
        "result_id", "added_to_scrape_queue")


DECISION_SQL = f"""
{SAME_DAY_SQL.strip()},
conflict AS (SELECT n.league_id, e.existing_id, o.quality_score AS old_score, concat_ws(', ', CASE WHEN abs(n.num_teams - o.num_teams) > 1 THEN 'num_teams' END,
    CASE WHEN lower(n.day_of_week) <> lower(o.day_of_week) THEN 'day_of_week' END,
    CASE WHEN lower(n.venue_name) <> lower(o.venue_name) THEN 'venue_name' END) AS conflicts
  FROM existing e JOIN listings n ON n.league_id = e.league_id LEFT JOIN listings o ON o.league_id = e.existing_id),
decided AS (SELECT league_id, existing_id, CASE WHEN existing_id IS NULL THEN 'NEW' WHEN conflicts = '' OR old_score >= 75 THEN 'MERGE'
  WHEN old_score < 60 THEN 'REPLACE' ELSE 'REVIEW' END AS decision FROM conflict)"""


@query("m15_reconcile_plan", f"""
WITH {match_sql(3)}, {PLAN_SQL}, {DECISION_SQL}
SELECT d.league_id, existing_id, decision, CASE WHEN decision <> 'REVIEW' THEN action END AS insert_action, CASE WHEN decision <> 'REVIEW' THEN match_id END AS match_id
FROM decided d JOIN plan p USING (league_id)""", ("listings_x",))
def _(t):
    return changes.reconcile_plan(t.incoming, t.stored).select("league_id", "existing_id", "decision", "insert_action", "match_id")


@query("m16_apply_confirmed_counts", f"""
WITH u AS (SELECT league_id, new_num_teams FROM checks WHERE {STATUS_SQL} = 'CHANGED'
  QUALIFY row_number() OVER (PARTITION BY league_id ORDER BY checked_at DESC, check_id DESC, new_num_teams DESC) = 1)
SELECT league_id, coalesce(new_num_teams, num_teams) AS num_teams FROM listings LEFT JOIN u USING (league_id)""", ("listings", "checks"))
def _(t):
    return changes.apply_confirmed_counts(t.listings, checks_with_status(t)).select("league_id", "num_teams")


_SIX = ["lower(organization_name)", "lower(sport_season_code)", "cast(season_year AS varchar)", "lower(venue_name)", "lower(day_of_week)", "lower(source_comp_level)"]
_AGREE = " + ".join(f"CASE WHEN a.f{i} = b.f{i} OR a.f{i} IS NULL OR b.f{i} IS NULL THEN 1 ELSE 0 END" for i in range(6))
# The walk in SQL: one recursion step per rank, with the list of used ranks as its state.
WALK_SQL = f"""
RECURSIVE k AS (SELECT league_id, url_scraped AS url, quality_score, {', '.join(f'{e} AS f{i}' for i, e in enumerate(_SIX))},
    row_number() OVER (PARTITION BY url_scraped ORDER BY coalesce(quality_score, 0) DESC, league_id) AS rn FROM listings WHERE NOT is_archived),
cand AS (SELECT a.url, a.rn, list({{'j': b.rn, 'm': {_AGREE}}} ORDER BY b.rn) AS js FROM k a JOIN k b ON a.url = b.url AND b.rn > a.rn WHERE {_AGREE} >= 4 GROUP BY 1, 2),
steps AS (SELECT k.url, k.rn, coalesce(js, []) AS js FROM k LEFT JOIN cand USING (url, rn)),
walk AS (SELECT DISTINCT url, 0::bigint AS i, []::bigint[] AS used, NULL::struct(j bigint, m integer) AS hit FROM k
  UNION ALL
  SELECT url, i, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.j) END, hit FROM (
    SELECT w.url, s.rn AS i, w.used, CASE WHEN list_contains(w.used, s.rn) THEN NULL
      ELSE list_filter(s.js, lambda c: NOT list_contains(w.used, c.j))[1] END AS hit FROM walk w JOIN steps s ON s.url = w.url AND s.rn = w.i + 1)),
pairs AS (SELECT w.url, a.league_id AS keep_id, b.league_id AS archive_id, hit.m AS matched_fields, CASE WHEN hit.m >= 5 THEN 'AUTO' ELSE 'REVIEW' END AS confidence,
    a.quality_score AS keep_quality, b.quality_score AS archive_quality
  FROM walk w JOIN k a ON a.url = w.url AND a.rn = w.i JOIN k b ON b.url = w.url AND b.rn = hit.j WHERE hit IS NOT NULL)"""


def recursive(sql):
    """The oracle's views come first, so RECURSIVE has to move up to the front."""
    return sql.replace("RECURSIVE k AS", "k AS", 1)


@query("r1_duplicate_pairs", f"WITH {recursive(WALK_SQL.strip())} SELECT url, keep_id, archive_id, matched_fields, confidence FROM pairs", ("RECURSIVE", "listings"))
def _(t):
    return dedupe.duplicate_pairs(t.listings.filter(~F.col("is_archived")))


@query("r2_duplicate_groups_of_urls", f"""
WITH {recursive(WALK_SQL.strip())} SELECT url, confidence, keep_id, archive_id, keep_quality, archive_quality FROM pairs""", ("RECURSIVE", "listings"))
def _(t):
    out = dedupe.duplicate_groups_of_urls(t.listings.filter(~F.col("is_archived")))
    return out.select("url", "confidence", "keep_id", "archive_id", F.col("keep.quality_score").alias("keep_quality"),
                      F.col("archive.quality_score").alias("archive_quality"))


_AFTER_COLUMNS = "league_id, url_scraped, organization_name, sport_season_code, season_year, venue_name, day_of_week, source_comp_level"
_WRITTEN = "SELECT p.* FROM plan p JOIN decided d USING (league_id) WHERE decision <> 'REVIEW'"
_AFTER_WRITES = f"""
gone AS (SELECT existing_id AS league_id FROM decided WHERE decision = 'REPLACE'),
old2 AS (SELECT * REPLACE (is_archived OR league_id IN (SELECT league_id FROM gone) AS is_archived) FROM listings_x),
to_merge AS ({_WRITTEN} AND action = 'MERGE'), {merged_sql("to_merge", "old2")},
after0 AS (SELECT {_AFTER_COLUMNS}, {SCORE_SQL} AS quality_score, is_archived FROM merged
  UNION ALL SELECT {_AFTER_COLUMNS}, quality_score, is_archived FROM old2 WHERE updated_at < date '{SPLIT_DAY}' AND league_id NOT IN (SELECT league_id FROM merged)
  UNION ALL SELECT {_AFTER_COLUMNS}, quality_score, is_archived FROM listings_x WHERE league_id IN (SELECT league_id FROM ({_WRITTEN} AND action = 'INSERT')))"""
_WALK_AFTER = recursive(WALK_SQL.strip()).replace("FROM listings WHERE NOT is_archived", "FROM after0 WHERE NOT is_archived").replace("pairs AS (", "dup AS (")


@query("m15_apply_reconcile", f"""
WITH {match_sql(3)}, {PLAN_SQL}, {DECISION_SQL},
{_AFTER_WRITES.strip()},
{_WALK_AFTER}
SELECT league_id, url_scraped, quality_score, is_archived OR league_id IN (SELECT archive_id FROM dup WHERE confidence = 'AUTO') AS is_archived FROM after0""",
       ("RECURSIVE", "listings_x"))
def _(t):
    plan = changes.reconcile_plan(t.incoming, t.stored)
    return changes.apply_reconcile(t.incoming, t.stored, plan, as_of()).select("league_id", "url_scraped", "quality_score", "is_archived")


@query("m15_reconcile_counters", f"""
WITH {match_sql(3)}, {PLAN_SQL}, {DECISION_SQL},
{_AFTER_WRITES.strip()},
{_WALK_AFTER}
SELECT count(*) AS leagues_extracted, count(*) FILTER (decision <> 'REVIEW' AND action IN ('INSERT', 'MERGE')) AS leagues_written,
  count(DISTINCT existing_id) FILTER (decision = 'REPLACE') AS archived, count(*) FILTER (decision = 'REVIEW') AS review_queued,
  (SELECT count(*) FROM dup WHERE confidence = 'AUTO') AS auto_consolidated
FROM decided d JOIN plan p USING (league_id)""", ("RECURSIVE", "listings_x"))
def _(t):
    plan = settle(changes.reconcile_plan(t.incoming, t.stored))
    after = changes.write_reconciled(t.incoming, t.stored, plan, as_of())
    return changes.reconcile_counters(plan, changes.sure_duplicates(after))


@query("m15_review_rows", f"""
WITH {match_sql(3)}, {PLAN_SQL}, {DECISION_SQL}
SELECT n.url_scraped AS url, d.existing_id AS existing_league_id, n.league_id AS extracted_id, n.num_teams AS extracted_teams
FROM decided d JOIN plan p USING (league_id) JOIN listings n ON n.league_id = d.league_id WHERE decision = 'REVIEW'""", ("listings_x",))
def _(t):
    out = changes.review_rows(t.incoming, changes.reconcile_plan(t.incoming, t.stored))
    seen = lambda f, kind: F.get_json_object("extracted", f"$.{f}").cast(kind)
    return out.select("url", "existing_league_id", seen("league_id", "bigint").alias("extracted_id"), seen("num_teams", "int").alias("extracted_teams"))


_NINE_KEYS = ["lower(organization_name)", "trim(lower(sport_name))",
              "cast(coalesce(greatest(year(season_start_date), year(season_end_date)), year(season_start_date), year(season_end_date)) AS varchar)",
              "lower(venue_name)", "lower(day_of_week)", "lower(source_comp_level)", "lower(gender_eligibility)", "cast(num_weeks AS varchar)",
              "cast(players_per_side AS varchar)"]
_FIT = "len(list_filter(list_zip(g.key, s.key), lambda p: p[1] <> p[2])) = 0 AND len(list_filter(list_zip(g.key, s.key), lambda p: p[1] = p[2]))"


def groups_sql(with_parents: bool) -> str:
    """Batch deduplication in SQL: one step per distinct key of a domain, the groups as its state."""
    related = "(s.parent = g.page OR g.parent = s.page) AND s.key[2] = g.key0[2]"
    fallback = f"list_position(list_transform(w.gs, lambda g: coalesce({related}, false) AND {_FIT} >= 1), true)" if with_parents else "NULL"
    parent = "CASE WHEN NOT suffix(page, '/0') THEN left(page, length(page) - 1) || '0' END" if with_parents else "NULL::varchar"
    return f"""
d AS (SELECT base_domain AS block, url_scraped AS page, [{', '.join(_NINE_KEYS)}] AS key, league_id FROM listings_x),
v AS (SELECT block, page, key, {parent} AS parent, min(league_id) AS first_id, list(league_id) AS ids FROM d GROUP BY block, page, key),
s0 AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY first_id) AS rn FROM v),
walk AS (SELECT DISTINCT block, 0::bigint AS i, []::struct(key varchar[], key0 varchar[], page varchar, parent varchar)[] AS gs, NULL::bigint AS spot, false AS opened FROM s0
  UNION ALL
  SELECT block, rn, CASE WHEN spot IS NULL THEN list_append(gs, {{'key': key, 'key0': key, 'page': page, 'parent': parent}})
      ELSE list_transform(gs, lambda g, n: CASE WHEN n = spot THEN {{'key': list_transform(list_zip(g.key, key), lambda p: coalesce(p[1], p[2])), 'key0': g.key0, 'page': g.page, 'parent': g.parent}} ELSE g END) END,
    coalesce(spot, len(gs) + 1), spot IS NULL FROM (
    SELECT w.block, s.rn, w.gs, s.key, s.page, s.parent,
      coalesce(list_position(list_transform(w.gs, lambda g: {_FIT} >= 3), true), {fallback}) AS spot
    FROM walk w JOIN s0 s ON s.block = w.block AND s.rn = w.i + 1)),
member AS (SELECT s.block, w.spot, s.first_id, unnest(s.ids) AS league_id, w.opened AND len(list_filter(s.key, lambda x: x IS NOT NULL)) < 3 AS solo
  FROM s0 s JOIN walk w ON w.block = s.block AND w.i = s.rn),
grouped AS (SELECT league_id, CASE WHEN solo AND league_id <> first_id THEN league_id
    ELSE min(league_id) FILTER (NOT (solo AND league_id <> first_id)) OVER (PARTITION BY block, spot) END AS group_id FROM member)"""


@query("r3_assign_groups", f"WITH {groups_sql(False).strip()} SELECT league_id, group_id FROM grouped", ("RECURSIVE", "listings_x"))
def _(t):
    return dedupe.assign_groups(t.listings_x)


@query("r3_assign_groups_with_parents", f"WITH {groups_sql(True).strip()} SELECT league_id, group_id FROM grouped", ("RECURSIVE", "listings_x"))
def _(t):
    return dedupe.assign_groups(t.listings_x, parent_map=page_parents(t))


@query("r3_deduplicate", f"WITH {groups_sql(False).strip()} SELECT group_id, count(*) AS merged_records FROM grouped GROUP BY group_id", ("RECURSIVE", "listings_x"))
def _(t):
    return dedupe.deduplicate(t.listings_x).select("group_id", "merged_records")

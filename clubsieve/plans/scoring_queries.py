"""Queries over the scoring and validation rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, scoring, similarity
from .fixtures import AS_OF
from .registry import query
from .sql_parts import pairs, RATIO_SQL


def as_of():
    return F.lit(AS_OF).cast("date")


def _penalties(alias="l") -> list[tuple[str, str, int]]:
    """(name, SQL condition, points), written against the fixture's types."""
    missing = lambda f: f"coalesce(cast({f} AS varchar), '') IN ('', '0', '0.00', 'false')"
    out = [(f"missing_{f}", missing(f), 20) for f in ("organization_name", "sport_season_code", "url_scraped")]
    out += [(f"missing_t1_{f}", missing(f), 8) for f in fv.TIER_ONE_FIELDS]
    out += [(f"missing_t2_{f}", missing(f), 3) for f in fv.TIER_TWO_FIELDS]
    out.append(("missing_team_fee_and_individual_fee", f"{missing('team_fee')} AND {missing('individual_fee')}", 8))
    valid = (f"length(sport_season_code) = 3 AND left(sport_season_code, 1) IN (SELECT c FROM (VALUES {pairs(fv.SEASON_BY_DIGIT)}) s(c, n)) "
             f"AND right(sport_season_code, 2) IN (SELECT c FROM (VALUES {pairs(fv.SPORT_BY_NUMBER)}) p(c, n))")
    out.append(("invalid_sport_season_code", f"sport_season_code <> '' AND NOT ({valid})", 10))
    for fee in ("team_fee", "individual_fee"):
        out.append((f"invalid_{fee}_negative_or_zero", f"{fee} < 0", 10))
        out.append((f"invalid_{fee}_not_numeric", "false", 10))
    out.append(("suspicious_num_teams_equals_one", "num_teams = 1", 15))
    out.append(("suspicious_num_teams_out_of_range", "num_teams < 0 OR num_teams > 1000", 10))
    out.append(("season_end_before_season_start", "season_end_date < season_start_date", 15))
    out.append(("season_duration_over_365_days", "season_end_date - season_start_date > 365", 5))
    out.append(("invalid_date_format", "false", 10))
    age = f"(date '{AS_OF}' - coalesce(season_start_date, season_end_date))"
    out.append(("stale_season_over_2_years", f"{age} > 730", 30))
    out.append(("stale_season_over_1_year", f"{age} BETWEEN 366 AND 730", 20))
    return out


SCORE_SQL = "greatest(0, 100" + "".join(f" - CASE WHEN {c} THEN {p} ELSE 0 END" for _, c, p in _penalties()) + ")"
PENALTY_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _penalties()) + ")"
_NINE = ("organization_name", "sport_name", "season_year", "venue_name", "day_of_week", "source_comp_level",
         "gender_eligibility", "num_weeks", "players_per_side")
NINE_COUNT = "(" + " + ".join(f"CASE WHEN coalesce(cast({f} AS varchar), '') = '' THEN 0 ELSE 1 END" for f in _NINE) + ")"
PCT_SQL = f"round({NINE_COUNT} * 100.0 / 9, 4)"


@query("v1_required_fields", """
SELECT league_id, sport_name IS NOT NULL OR sport_season_code IS NOT NULL AS ok,
  CASE WHEN sport_name IS NULL AND sport_season_code IS NULL THEN 'sport_name' ELSE '' END AS missing FROM listings""",
       ("listings",))
def _(t):
    df = t.listings
    m = scoring.missing_required(df)
    return df.select("league_id", (F.size(m) == 0).alias("ok"), F.array_join(m, ",").alias("missing"))


@query("v2_quality_score", f"SELECT league_id, {SCORE_SQL} AS score, {PENALTY_SQL} AS penalties FROM listings", ("listings",))
def _(t):
    df = t.listings
    return df.select("league_id", scoring.quality_score(df, as_of()).alias("score"),
                     F.array_join(scoring.quality_penalties(df, as_of()), ",").alias("penalties"))


@query("v3_validation_report", f"""
WITH v AS (SELECT league_id, sport_name IS NULL AND sport_season_code IS NULL AS bad, {SCORE_SQL} AS score FROM listings)
SELECT league_id, NOT bad AS is_valid, CASE WHEN bad THEN 0 ELSE score END AS score,
  CASE WHEN bad THEN concat('Quality Score: 0/100', chr(10), 'Missing Required: sport_name', chr(10), 'Errors:', chr(10),
      '  - Missing required fields: sport_name', chr(10), '❌ Invalid')
    ELSE concat('Quality Score: ', score, '/100', chr(10), '✅ Valid') END AS report FROM v""", ("listings",))
def _(t):
    df = t.listings
    v = scoring.validation(df, as_of())
    return df.select("league_id", v.alias("v")).select(
        "league_id", "v.is_valid", "v.score", scoring.validation_report(F.col("v")).alias("report"))


BROAD_TYPES = ("Indoor", "Outdoor", "Beach", "Ice", "Pool", "Unknown")  # fixed values
SPECIFIC_TYPES = ("Gym/Rec Centre", "Turf Field", "Grass Field", "Beach", "Ice Rink",  # fixed values
                  "Tennis-Pickleball", "Baseball Diamond", "Swimming Pool", "Other")


@query("v4_enum_guard", """
SELECT venue_id, CASE WHEN venue_id % 4 < 2 THEN court_type_broad ELSE 'Unknown' END AS broad,
  CASE WHEN venue_id % 4 < 2 THEN court_type_broad_conf ELSE 0 END AS broad_conf,
  CASE WHEN venue_id % 3 < 2 THEN court_type_specific ELSE 'Other' END AS specific,
  CASE WHEN venue_id % 3 < 2 THEN court_type_specific_conf ELSE 0 END AS specific_conf FROM venues""", ("venues",))
def _(t):
    b = scoring.enum_or(F.col("court_type_broad"), F.col("court_type_broad_conf"), BROAD_TYPES, "Unknown")
    s = scoring.enum_or(F.col("court_type_specific"), F.col("court_type_specific_conf"), SPECIFIC_TYPES, "Other")
    return t.venues.select("venue_id", b["value"].alias("broad"), b["confidence"].alias("broad_conf"),
                           s["value"].alias("specific"), s["confidence"].alias("specific_conf"))


@query("v5_completeness", f"""
SELECT league_id, {PCT_SQL} AS pct, CASE WHEN {NINE_COUNT} >= 8 THEN 'COMPLETE' WHEN {NINE_COUNT} >= 6 THEN 'ACCEPTABLE'
  WHEN {NINE_COUNT} >= 3 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM listings""", ("listings",))
def _(t):
    df = t.listings
    p = scoring.completeness(df)
    return df.select("league_id", F.round(p, 4).alias("pct"), scoring.completeness_status(p).alias("status"))


@query("v6_completeness_eight", """
WITH n AS (SELECT league_id, 2 + (sport_season_code IS NOT NULL)::int + (venue_name IS NOT NULL)::int + (day_of_week IS NOT NULL)::int
  + (source_comp_level IS NOT NULL)::int + (gender_eligibility IS NOT NULL)::int + (num_weeks IS NOT NULL)::int AS k FROM listings)
SELECT league_id, (k * 12.5)::double AS pct, CASE WHEN k = 8 THEN 'COMPLETE' WHEN k = 7 THEN 'ACCEPTABLE' WHEN k >= 4 THEN 'PARTIAL'
  ELSE 'FAILED' END AS status FROM n""", ("listings",))
def _(t):
    df = t.listings
    p = scoring.completeness(df, "eight")
    return df.select("league_id", p.alias("pct"), scoring.completeness_status(p, "eight").alias("status"))


@query("v7_quality_band", """
SELECT league_id, CASE WHEN quality_score BETWEEN 60 AND 74 THEN 'BORDERLINE' WHEN quality_score BETWEEN 75 AND 89 THEN 'ACCEPTABLE'
  WHEN quality_score >= 90 THEN 'SUBSTANTIAL' ELSE 'THIN' END AS band FROM listings""", ("listings",))
def _(t):
    return t.listings.select("league_id", scoring.quality_band(F.col("quality_score")).alias("band"))


def venue_match(t):
    """Venues scored against the place they were matched to."""
    kinds = F.when(F.col("venue_id") % 2 == 0, F.array(F.lit("park"), F.lit("cafe"))).otherwise(F.array(F.lit("cafe")))
    return t.venues.select(
        "venue_id", similarity.venue_confidence(
            F.col("venue_name"), F.concat(F.lit("Town NATION_"), F.col("venue_id") % 25), F.col("google_name"),
            F.col("address"), kinds, F.col("venue_id") % 3).alias("confidence"))


@query("v8_venue_confidence", f"""
WITH pairs AS (SELECT lower(venue_name) AS a, lower(google_name) AS b FROM venues WHERE google_name IS NOT NULL), {RATIO_SQL}
SELECT venue_id, CASE WHEN google_name IS NULL THEN 0 ELSE round_even(ratio * 40, 0)::INT
  + CASE WHEN contains(lower(address), lower('Town NATION_' || venue_id % 25)) THEN 30 ELSE 0 END
  + CASE WHEN venue_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN venue_id % 3 > 0 THEN 10 ELSE 0 END END AS confidence
FROM venues LEFT JOIN ratios ON a = lower(venue_name) AND b = lower(google_name)""", ("RECURSIVE", "venues"))
def _(t):
    return venue_match(t)


@query("v9_venue_route", """
SELECT venue_id, CASE WHEN confidence_score >= 60 THEN 'auto_saved' ELSE 'queued' END AS route FROM venues""", ("venues",))
def _(t):
    return t.venues.select("venue_id", scoring.venue_route(F.col("confidence_score")).alias("route"))


STATUS_SQL = """CASE WHEN new_num_teams = 0 THEN 'NOT_FOUND' WHEN old_num_teams BETWEEN new_num_teams - 1 AND new_num_teams + 1
  THEN 'MATCH' ELSE 'CHANGED' END"""


@query("v10_check_status", f"SELECT check_id, {STATUS_SQL} AS status FROM checks", ("checks",))
def _(t):
    return t.checks.select("check_id", scoring.check_status(F.col("old_num_teams"), F.col("new_num_teams")).alias("status"))


def record_pairs(t):
    """Each later listing beside the newest earlier one of the same URL."""
    old = t.stored.groupBy("url_scraped").agg(F.max_by(
        F.struct("league_id", "num_teams", "day_of_week", "venue_name", "quality_score"),
        F.struct("updated_at", "league_id")).alias("old"))
    return t.incoming.join(old, "url_scraped")


PAIRS_SQL = """
pair AS (SELECT n.*, o.league_id AS old_id, o.num_teams AS old_teams, o.day_of_week AS old_day, o.venue_name AS old_venue,
    o.quality_score AS old_score
  FROM listings n JOIN (SELECT * FROM listings WHERE updated_at < date '1999-06-01'
    QUALIFY row_number() OVER (PARTITION BY url_scraped ORDER BY updated_at DESC, league_id DESC) = 1) o USING (url_scraped)
  WHERE n.updated_at >= date '1999-06-01'),
conflict AS (SELECT *, concat_ws(', ', CASE WHEN abs(num_teams - old_teams) > 1 THEN 'num_teams' END,
    CASE WHEN lower(day_of_week) <> lower(old_day) THEN 'day_of_week' END,
    CASE WHEN lower(venue_name) <> lower(old_venue) THEN 'venue_name' END) AS conflicts FROM pair)"""


def conflicts():
    new = {f: F.col(f) for f in ("num_teams", "day_of_week", "venue_name")}
    return scoring.contradictions(new, {f: F.col("old")[f] for f in new})


@query("v11_contradictions", f"WITH {PAIRS_SQL} SELECT league_id, old_id, conflicts FROM conflict", ("listings",))
def _(t):
    return record_pairs(t).select("league_id", F.col("old.league_id").alias("old_id"),
                                  F.array_join(conflicts(), ", ").alias("conflicts"))


@query("v12_reconcile", f"""
WITH {PAIRS_SQL} SELECT league_id, old_id, CASE WHEN conflicts = '' OR old_score >= 75 THEN 'MERGE' WHEN old_score < 60 THEN 'REPLACE'
    ELSE 'REVIEW' END AS action,
  CASE WHEN conflicts = '' THEN 'no contradiction'
    WHEN old_score < 75 THEN 'contradictions: ' || conflicts
    ELSE concat('existing quality sufficient (', old_score, ') — contradictions: ', conflicts) END AS reason
FROM conflict""", ("listings",))
def _(t):
    r = scoring.reconcile(conflicts(), F.col("old.quality_score"))
    return record_pairs(t).select("league_id", F.col("old.league_id").alias("old_id"), r.alias("r")).select(
        "league_id", "old_id", "r.action", "r.reason")


@query("v13_insert_gate", f"""
SELECT league_id FROM listings WHERE {NINE_COUNT} * 100.0 / 9 >= CASE WHEN requires_insurance THEN 25 ELSE 50 END""", ("listings",))
def _(t):
    df = t.listings
    child = F.coalesce("requires_insurance", F.lit(False))
    return df.filter(scoring.passes_insert_gate(scoring.completeness(df), child)).select("league_id")


@query("v14_route_urls", """
SELECT url_scraped, min(quality_score) AS min_quality, CASE WHEN min(quality_score) < 75 THEN 'deep' ELSE 'standard' END AS route
FROM listings GROUP BY url_scraped""", ("listings",))
def _(t):
    q = F.min(F.coalesce("quality_score", F.lit(0)))
    return t.listings.groupBy("url_scraped").agg(
        q.alias("min_quality"), F.when(q < fv.DEEP_BELOW, "deep").otherwise("standard").alias("route"))


@query("v15_review_flag", """
SELECT snapshot_id, CASE WHEN fetch_method = 'multi_page_selenium' AND pages_visited > 1 THEN 'MULTI_PAGE'
  WHEN fetch_method = 'single_page_selenium' THEN 'MAIN_PAGE_ONLY' END AS flag FROM snapshots""", ("snapshots",))
def _(t):
    return t.snapshots.select("snapshot_id", scoring.review_flag(F.col("fetch_method"), F.col("pages_visited")).alias("flag"))

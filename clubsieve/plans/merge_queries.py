"""Queries over survivorship merges and patches."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import matching, merge, ranking, reports
from ..session import settle
from .join_queries import match_sql
from .registry import query
from .scoring_queries import NINE_COUNT, SCORE_SQL, as_of

_SHOWN = ("organization_name", "sport_season_code", "season_year", "venue_name", "day_of_week", "source_comp_level", "gender_eligibility",
          "num_weeks", "players_per_side", "num_teams", "team_fee", "start_time")
_ALL = ("league_id", "organization_name", "url_scraped", "sport_season_code", "sport_name", "season_name", "season_start_date", "season_end_date",
        "season_year", "venue_name", "day_of_week", "source_comp_level", "gender_eligibility", "num_weeks", "players_per_side", "num_teams",
        "team_fee", "individual_fee", "start_time", "has_referee", "time_played_per_week", "registration_deadline", "stat_holidays", "slots_left",
        "requires_insurance", "insurance_policy_link", "division_name", "quality_score", "is_archived", "updated_at")
_FILLED = "(" + " + ".join(f"({c} IS NOT NULL)::int" for c in _ALL) + ")"


@query("r4_merge_groups", f"""
WITH ranked AS (SELECT *, {_FILLED} AS n FROM listings),
m AS (SELECT url_scraped, count(*) AS merged_records, {', '.join(f'first({c} ORDER BY n DESC, league_id) FILTER ({c} IS NOT NULL) AS {c}' for c in ('league_id', 'sport_name', 'quality_score') + _SHOWN)}
  FROM ranked GROUP BY url_scraped)
SELECT url_scraped, league_id, merged_records, {', '.join(_SHOWN)}, round({NINE_COUNT} * 100.0 / 9, 1) AS pct FROM m""", ("listings",))
def _(t):
    return merge.merge_groups(t.listings, ["url_scraped"]).select(
        "url_scraped", "league_id", "merged_records", *_SHOWN, F.col("identifying_fields_pct").alias("pct"))


def merged_sql(pairs: str = "best", old: str = "listings_x") -> str:
    """Stored records with all of their partners merged: per column the first value by score, new before stored."""
    values = ", ".join(f"first({c} ORDER BY quality_score DESC, is_new DESC, id) FILTER ({c} IS NOT NULL) AS {c}"
                       for c in _ALL if c not in ("league_id", "quality_score"))
    return f"""
parts AS (SELECT n.* RENAME (league_id AS id), b.match_id AS target, true AS is_new FROM listings_x n JOIN {pairs} b ON b.league_id = n.league_id
  UNION ALL SELECT o.* RENAME (league_id AS id), league_id, false FROM {old} o WHERE league_id IN (SELECT match_id FROM {pairs})),
merged AS (SELECT target AS league_id, {values} FROM parts GROUP BY target)"""


@query("r5_merge_pairs", f"""
WITH {match_sql(3)}, {merged_sql()} SELECT b.league_id AS merged_from, m.league_id, {', '.join(_SHOWN)}, {SCORE_SQL} AS quality_score
FROM best b JOIN merged m ON m.league_id = b.match_id""", ("listings_x",))
def _(t):
    pairs = settle(matching.best_matches(t.incoming, t.stored))
    return merge.merge_pairs(t.incoming, t.stored, pairs, as_of()).select("merged_from", "league_id", *_SHOWN, "quality_score")


def copy_pairs(t):
    """The two best-scored members of every group of copies."""
    keyed = reports.duplicate_groups(t.active, columns=("league_id", "quality_score"))
    ks = [c for c in keyed.columns if c.startswith("key_")]
    order = [F.desc("quality_score"), "league_id"]
    best = ranking.best_row(keyed, ks, order).select(*ks, F.col("league_id").alias("keep_id"))
    rest = keyed.join(best, ks).filter("league_id <> keep_id")
    return ranking.best_row(rest, "keep_id", order).select("keep_id", F.col("league_id").alias("archive_id"))


COPY_PAIRS_SQL = """
ranked AS (SELECT league_id, quality_score, row_number() OVER w AS rn, first_value(league_id) OVER w AS keep_id FROM active
  WINDOW w AS (PARTITION BY lower(organization_name), coalesce(lower(sport_season_code), ''), coalesce(season_year, 0), coalesce(lower(venue_name), ''),
    coalesce(lower(day_of_week), ''), coalesce(lower(source_comp_level), '') ORDER BY quality_score DESC, league_id)),
pairs AS (SELECT keep_id, league_id AS archive_id FROM ranked WHERE rn = 2)"""


@query("r6_absorb", f"""
WITH {COPY_PAIRS_SQL} SELECT k.league_id, {', '.join(f'coalesce(k.{c}, o.{c}) AS {c}' for c in _SHOWN)},
  k.is_archived OR k.league_id IN (SELECT archive_id FROM pairs) AS is_archived
FROM listings_x k LEFT JOIN pairs p ON p.keep_id = k.league_id LEFT JOIN listings_x o ON o.league_id = p.archive_id""", ("active",))
def _(t):
    return merge.absorb(t.listings_x, copy_pairs(t)).select("league_id", *_SHOWN, "is_archived")


@query("r6_absorb_all", f"""
WITH ranked AS (SELECT league_id, first_value(league_id) OVER w AS keep_id, row_number() OVER w AS rn FROM active
  WINDOW w AS (PARTITION BY lower(organization_name), lower(coalesce(sport_season_code, '')) ORDER BY quality_score DESC, league_id)),
pairs AS (SELECT keep_id, league_id AS archive_id, rn FROM ranked WHERE rn > 1),
given AS (SELECT keep_id, {', '.join(f'first(o.{c} ORDER BY rn) FILTER (o.{c} IS NOT NULL) AS {c}' for c in _SHOWN)} FROM pairs JOIN listings_x o ON o.league_id = archive_id GROUP BY keep_id)
SELECT k.league_id, {', '.join(f'coalesce(k.{c}, g.{c}) AS {c}' for c in _SHOWN)}, k.is_archived OR k.league_id IN (SELECT archive_id FROM pairs) AS is_archived
FROM listings_x k LEFT JOIN given g ON g.keep_id = k.league_id""", ("active",))
def _(t):
    """Every record of an organisation and season merged into the best one, in order of quality."""
    keyed = t.active.withColumn("season", F.lower(F.coalesce("sport_season_code", F.lit("")))).withColumn("org", F.lower("organization_name"))
    order = [F.desc("quality_score"), "league_id"]
    best = ranking.best_row(keyed, ["org", "season"], order).select("org", "season", F.col("league_id").alias("keep_id"))
    pairs = keyed.join(best, ["org", "season"]).filter("league_id <> keep_id").select(
        "keep_id", F.col("league_id").alias("archive_id"), (-F.col("quality_score")).alias("order"))
    return merge.absorb(t.listings_x, pairs).select("league_id", *_SHOWN, "is_archived")


@query("r7_compare", f"WITH {COPY_PAIRS_SQL}, sides AS (" + " UNION ALL ".join(
    f"SELECT keep_id, archive_id, '{f}' AS field, cast(a.{f} AS varchar) AS kept_value, cast(b.{f} AS varchar) AS other_value FROM pairs "
    f"JOIN listings_x a ON a.league_id = keep_id JOIN listings_x b ON b.league_id = archive_id" for f in fv.COMPARED_FIELDS)
       + ") SELECT * FROM sides WHERE kept_value IS DISTINCT FROM other_value", ("active",))
def _(t):
    return merge.compare(t.listings_x, copy_pairs(t))


# Patch inputs come from the order lines: the field by part number, the value by quantity.
_PATCH_FIELDS = ("num_weeks", "slots_left", "players_per_side", "time_played_per_week")


def patch_rows(t):
    field = F.element_at(F.array(*[F.lit(f) for f in _PATCH_FIELDS]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return t.table("lineitem").select(F.col("l_orderkey").alias("league_id"), field.alias("field"),
                                      F.col("l_quantity").cast("int").cast("string").alias("value"), "l_returnflag", "l_suppkey")


def patch_inputs(t):
    rows = patch_rows(t)
    page = rows.join(t.listings.select("league_id", F.col("url_scraped").alias("url")), "league_id")
    kind = lambda df, flag: df.filter(F.col("l_returnflag") == flag)
    return (kind(rows, "A").select("league_id", "field", "value"),
            kind(page, "N").select("url", F.struct("l_suppkey", "league_id", "value").alias("page_order"), "field", "value"),
            kind(rows, "R").select("league_id", "field", "value"))


PATCH_SQL = f"""
rows AS (SELECT l_orderkey AS league_id, CASE l_partkey % 4 {' '.join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_PATCH_FIELDS))} END AS field,
  cast(cast(l_quantity AS int) AS varchar) AS value, l_returnflag, l_suppkey FROM lineitem),
url_of AS (SELECT league_id, url_scraped AS url FROM listings),
slots AS (""" + " UNION ALL ".join(f"SELECT league_id, url_scraped AS url, '{f}' AS field FROM listings WHERE {f} IS NULL" for f in fv.ENRICHABLE_FIELDS) + """),
snap AS (SELECT league_id, field, min(value) AS v FROM rows WHERE l_returnflag = 'A' GROUP BY ALL),
snap_url AS (SELECT DISTINCT url, field FROM snap JOIN url_of USING (league_id)),
page AS (SELECT url, field, value AS v FROM rows JOIN url_of USING (league_id) WHERE l_returnflag = 'N'
  QUALIFY row_number() OVER (PARTITION BY url, field ORDER BY l_suppkey, league_id, value) = 1),
late AS (SELECT league_id, field, min(value) AS v FROM rows JOIN url_of USING (league_id)
  WHERE l_returnflag = 'R' AND url NOT IN (SELECT url FROM snap_url) GROUP BY league_id, field),
choice AS (SELECT s.league_id, s.field, coalesce(snap.v, page.v, late.v) AS value,
    CASE WHEN snap.v IS NOT NULL THEN 'snapshot' WHEN page.v IS NOT NULL THEN 'pages' WHEN late.v IS NOT NULL THEN 'scrape' END AS source
  FROM slots s LEFT JOIN snap USING (league_id, field)
  LEFT JOIN page ON page.url = s.url AND page.field = s.field AND (s.url, s.field) NOT IN (SELECT (url, field) FROM snap_url)
  LEFT JOIN late ON late.league_id = s.league_id AND late.field = s.field)"""


@query("r8_choose_patches", f"WITH {PATCH_SQL} SELECT * FROM choice", ("listings",))
def _(t):
    return merge.choose_patches(t.listings, *patch_inputs(t))


@query("r8_patch_summary", f"""
WITH {PATCH_SQL} SELECT league_id, coalesce(string_agg(field, ',' ORDER BY field) FILTER (value IS NOT NULL), '') AS filled,
  coalesce(string_agg(field, ',' ORDER BY field) FILTER (value IS NULL), '') AS skipped FROM choice GROUP BY league_id""", ("listings",))
def _(t):
    s = merge.patch_summary(merge.choose_patches(t.listings, *patch_inputs(t)))
    return s.select("league_id", F.array_join("filled", ",").alias("filled"), F.array_join("skipped", ",").alias("skipped"))


@query("m8_apply_patches", f"""
WITH {PATCH_SQL}, wide AS (SELECT league_id, {', '.join(f"max(value) FILTER (field = '{f}')::int AS p_{f}" for f in _PATCH_FIELDS)} FROM choice WHERE value IS NOT NULL GROUP BY 1),
merged AS (SELECT l.* REPLACE ({', '.join(f'coalesce(l.{f}, p_{f}) AS {f}' for f in _PATCH_FIELDS)}), w.league_id IS NOT NULL AS changed FROM listings l LEFT JOIN wide w USING (league_id))
SELECT league_id, {', '.join(_PATCH_FIELDS)}, CASE WHEN changed THEN {SCORE_SQL} ELSE quality_score END AS quality_score FROM merged""", ("listings",))
def _(t):
    choices = merge.choose_patches(t.listings, *patch_inputs(t))
    return merge.apply_patches(t.listings, choices, as_of()).select("league_id", *_PATCH_FIELDS, "quality_score")

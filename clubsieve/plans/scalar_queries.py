"""Queries over the scalar functions: URLs, text, codes, levels, keys and screening."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, fixed_values as fv, keys, levels, screening, text, urls
from .registry import query
from .sql_parts import (CASE_CITY, any_contains, hit_count, in_list, pairs, title_words)

HOST = "regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1)"
PATH = "regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("x1_canonicalize_url", """
SELECT page_id, regexp_replace(replace(regexp_replace(regexp_replace(
    regexp_replace(lower(url), '/$', ''), '[?&](utm_[^&]+|fbclid=[^&]+|gclid=[^&]+)', '', 'g'),
    '^http://', 'https://'), '://www.', '://'), '[?&]$', '') AS canonical_url FROM pages""")
def _(t):
    return t.table("pages").select("page_id", urls.canonicalize_url(F.col("url")).alias("canonical_url"))


@query("x1_canonicalize_result_url", """
SELECT result_id, CASE WHEN suffix(url_raw, '/') THEN left(lower(url_raw), length(url_raw) - 1)
    ELSE replace(lower(url_raw), '?utm_source=x', '') END.replace('://www.', '://') AS canonical_url
FROM results""", ("results",))
def _(t):
    return t.results.select("result_id", urls.canonicalize_url(F.col("url_raw")).alias("canonical_url"))


@query("x2_normalize_url", """
WITH p AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages),
q AS (SELECT page_id, u, regexp_replace(""" + HOST.format("u") + """, '^www\\.', '') AS h,
  rtrim(""" + PATH.format("u") + """, '/') AS p FROM p)
SELECT page_id, concat('https://', h, CASE WHEN p = '' THEN '/' ELSE p END,
  CASE WHEN contains(u, '?') AND NOT suffix(u, '?') THEN concat('?', substr(u, strpos(u, '?') + 1)) ELSE '' END) AS normal_url
FROM q""")
def _(t):
    return t.table("pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal_url"))


@query("x3_base_domain", """
SELECT page_id, array_to_string(string_split(""" + HOST.format("url") + """, '.')[-2:], '.') AS base_domain
FROM pages""")
def _(t):
    return t.table("pages").select("page_id", urls.base_domain(F.col("url")).alias("base_domain"))


@query("x4_same_site", """
SELECT page_id, position, (h = b OR suffix(h, '.' || b)) AS same_site FROM (
  SELECT page_id, position, regexp_extract(source_url, '://([^/?#]*)', 1) AS h,
         array_to_string(string_split(regexp_extract(source_url, '://([^/?#]*)', 1), '.')[-2:], '.') AS b
  FROM links)""", ("links",))
def _(t):
    root = F.concat(F.lit("https://"), urls.base_domain(F.col("source_url")))
    return t.links.select("page_id", "position",
                          urls.same_site(F.col("discovered_url"), root).alias("same_site"))


@query("x5_is_fetchable", f"""
SELECT result_id, NOT ({' OR '.join(f"suffix(lower(url_raw), '{e}')" for e in fv.UNFETCHABLE_ENDINGS)}) AS fetchable
FROM results""", ("results",))
def _(t):
    return t.results.select("result_id", urls.is_fetchable(F.col("url_raw")).alias("fetchable"))


@query("x6_city_from_url", f"SELECT league_id, {CASE_CITY} AS city FROM listings", ("listings",))
def _(t):
    return t.listings.select("league_id", urls.city_from_url(F.col("url_scraped")).alias("city"))


_LABEL = "split_part(regexp_extract(lower(url_raw), '^[a-z]+://(?:www\\.)?([^/?#]*)', 1), '.', 1)"


@query("x7_org_name", f"""
SELECT result_id, CASE WHEN length({_LABEL}) > 1
    AND len(regexp_extract_all({_LABEL}, '[0-9]')) <= length({_LABEL}) / 2.0 THEN upper({_LABEL})
    ELSE split_part(page_title, ' ', 1) END AS organization_name FROM results""", ("results",))
def _(t):
    return t.results.select("result_id", urls.org_name(F.col("url_raw"), F.col("page_title")).alias("organization_name"))


_CONTENT = "lower(concat(page_title, ' ', page_snippet))"
_REASON = f"""CASE
  WHEN {' OR '.join(f"suffix(lower(url_raw), '{e}')" for e in fv.DOCUMENT_ENDINGS)} THEN 'invalid_file_type'
  WHEN {any_contains('lower(url_raw)', fv.BLOCKED_HOSTS)} THEN CASE WHEN contains(lower(url_raw), 'yelp.com') THEN 'review_site' ELSE 'social_media' END
  WHEN {any_contains('lower(url_raw)', fv.PROFESSIONAL_WORDS)} OR {any_contains(_CONTENT, fv.PROFESSIONAL_WORDS)} THEN 'professional_sports'
  WHEN {any_contains('lower(url_raw)', fv.YOUTH_WORDS)} OR {any_contains(_CONTENT, fv.YOUTH_WORDS)}
    OR regexp_matches({_CONTENT}, '\\bu[0-9]{{1,2}}\\b') THEN 'youth_organization'
  WHEN {any_contains(_CONTENT, fv.OFF_TOPIC_WORDS)} THEN 'not_league_content'
  WHEN {any_contains(_CONTENT, fv.ON_TOPIC_WORDS)} OR regexp_matches(lower(url_raw), '^[a-z]+://[^/]*\\.(com|org|net|ca|io|app)(/|$)')
    THEN CASE WHEN {hit_count(_CONTENT, fv.ADULT_WORDS)} >= 2 THEN 'valid_adult_rec_league' ELSE 'valid_league_page' END
  ELSE 'not_league_content' END"""


@query("x8_validate_url", f"""
SELECT result_id, reason, prefix(reason, 'valid_') AS is_valid FROM (SELECT result_id, {_REASON} AS reason FROM results)""",
       ("results",))
def _(t):
    return t.screened_results.select("result_id", "is_valid", F.col("validation_reason").alias("reason"))


@query("x8_validate_page_url", f"""
SELECT page_id, CASE WHEN {any_contains('lower(url)', fv.PROFESSIONAL_WORDS)} THEN 'professional_sports'
  WHEN {any_contains('lower(url)', fv.YOUTH_WORDS)} THEN 'youth_organization'
  WHEN regexp_matches(url, '^[a-z]+://[^/]*\\.(com|org|net|ca|io|app)(/|$)') THEN 'valid_league_page'
  ELSE 'not_league_content' END AS reason FROM pages""")
def _(t):
    return t.table("pages").select("page_id", screening.validation_reason(F.col("url"), F.lit(" ")).alias("reason"))


@query("x9_adult_indicators", f"""
SELECT result_id, {hit_count(_CONTENT, fv.ADULT_WORDS)} >= 2 AS adult FROM results""", ("results",))
def _(t):
    content = screening.content_of(F.col("page_title"), F.col("page_snippet"))
    return t.results.select("result_id", screening.adult_indicators(content).alias("adult"))


@query("x10_priority", f"""
WITH r AS (SELECT *, {_CONTENT} AS content, {_REASON} AS reason FROM results),
s AS (SELECT result_id, CASE WHEN {in_list(f'upper({_LABEL})', fv.KNOWN_ORGANISATIONS)} THEN 40 ELSE 0 END
  + least(30, 10 * {hit_count('content', fv.ADULT_WORDS)})
  + CASE WHEN search_rank <= 6 THEN 15 WHEN search_rank <= 10 THEN 10 ELSE 5 END
  + CASE WHEN {any_contains('content', fv.PRIORITY_WORDS)} THEN 10 ELSE 0 END
  + CASE WHEN contains(lower(url_raw), '.org') OR contains(lower(url_raw), '.ca') THEN 10 ELSE 0 END
  + CASE WHEN reason = 'valid_adult_rec_league' THEN 20 ELSE 0 END AS points FROM r)
SELECT result_id, CASE WHEN points >= 40 THEN 1 WHEN points >= 20 THEN 2 ELSE 3 END AS priority FROM s""", ("results",))
def _(t):
    ranked = t.screened_results
    return ranked.select("result_id", screening.priority(
        F.col("url_raw"), F.col("content"), F.col("search_rank"), F.col("organization_name"), F.col("validation_reason")).alias("priority"))


@query("x11_norm_text", """
SELECT league_id, regexp_replace(trim(lower(coalesce(sport_name, ''))), ' {2,}', ' ', 'g') AS sport,
  coalesce(lower(venue_name), '') AS venue FROM listings""", ("listings",))
def _(t):
    return t.listings.select("league_id", text.norm_text(F.col("sport_name")).alias("sport"),
                             text.norm_text(F.col("venue_name")).alias("venue"))


@query("x12_season_year", """
SELECT league_id, CASE WHEN season_start_date IS NULL THEN year(season_end_date)
  WHEN season_end_date IS NULL THEN year(season_start_date)
  ELSE greatest(year(season_start_date), year(season_end_date)) END AS derived_year FROM listings""", ("listings",))
def _(t):
    return t.listings.select("league_id", keys.season_year(
        F.col("season_start_date"), F.col("season_end_date")).alias("derived_year"))


_KEY_SQL = """
SELECT league_id, lower(organization_name) AS organization_name, coalesce(trim(lower(sport_name)), '') AS sport_name,
  greatest(year(season_start_date), year(season_end_date)) AS season_year,
  coalesce(lower(venue_name), '') AS venue_name, coalesce(lower(day_of_week), '') AS day_of_week,
  coalesce(lower(source_comp_level), '') AS source_comp_level,
  coalesce(lower(gender_eligibility), '') AS gender_eligibility, num_weeks, players_per_side FROM listings"""


@query("x13_uniqueness_key", _KEY_SQL, ("listings",))
def _(t):
    return t.listings.select("league_id", keys.uniqueness_key().alias("k")).select("league_id", "k.*")


@query("x14_display_name", f"""
SELECT league_id, CASE WHEN players_per_side IS NULL AND sport_name IS NULL AND day_of_week IS NULL
    AND source_comp_level IS NULL AND gender_eligibility IS NULL THEN organization_name
  ELSE array_to_string(list_filter([players_per_side || 'v' || players_per_side, {title_words('sport_name')},
    {title_words('day_of_week')}, {title_words('source_comp_level')}, {title_words('gender_eligibility')}],
    lambda x: x IS NOT NULL), ' | ') END AS display_name FROM listings""", ("listings",))
def _(t):
    return t.listings.select("league_id", keys.display_name().alias("display_name"))


@query("x15_key_label", f"""
WITH k AS ({_KEY_SQL})
SELECT league_id, concat('org=', left(organization_name, 20), ' | sport=', left(sport_name, 15), ' | year=',
  coalesce(cast(season_year AS varchar), 'None'), ' | venue=', left(venue_name, 20), ' | dow=', left(day_of_week, 3),
  ' | level=', left(source_comp_level, 3), ' | gender=', left(gender_eligibility, 3), ' | weeks=',
  coalesce(cast(num_weeks AS varchar), 'None'), ' | pps=', coalesce(cast(players_per_side AS varchar), 'None')) AS key_label
FROM k""", ("listings",))
def _(t):
    return t.listings.select("league_id", keys.key_label(keys.uniqueness_key()).alias("key_label"))


@query("x16_code_parts", f"""
SELECT league_id, s.name IS NOT NULL AND p.name IS NOT NULL AS valid,
  CASE WHEN p.name IS NOT NULL THEN s.name END AS season, CASE WHEN s.name IS NOT NULL THEN p.name END AS sport
FROM listings LEFT JOIN (VALUES {pairs(fv.SEASON_BY_DIGIT)}) s(code, name) ON s.code = left(sport_season_code, 1) AND length(sport_season_code) = 3
LEFT JOIN (VALUES {pairs(fv.SPORT_BY_NUMBER)}) p(code, name) ON p.code = right(sport_season_code, 2)""", ("listings",))
def _(t):
    c = F.col("sport_season_code")
    return t.listings.select("league_id", codes.valid_code(c).alias("valid"),
                             codes.season_of_code(c).alias("season"), codes.sport_of_code(c).alias("sport"))


@query("x16_build_code", f"""
SELECT league_id, s.code || p.code AS code FROM listings
LEFT JOIN (VALUES {pairs(fv.SEASON_BY_DIGIT)}) s(code, name) ON lower(s.name) = lower(season_name)
LEFT JOIN (VALUES {pairs(fv.SPORT_BY_NUMBER)}) p(code, name) ON lower(p.name) = lower(sport_name)""", ("listings",))
def _(t):
    return t.listings.select("league_id", codes.build_code(F.col("season_name"), F.col("sport_name")).alias("code"))


@query("x17_derive_code", """
SELECT league_id, CASE season_name WHEN 'Summer' THEN '2' WHEN 'Late Winter' THEN '4' WHEN 'Fall' THEN '3' END
  || CASE sport_name WHEN 'Soccer' THEN '01' WHEN 'Volleyball' THEN '11' WHEN 'Softball' THEN '41' END AS code
FROM listings""", ("listings",))
def _(t):
    season = codes.season_label(F.col("season_name"))
    return t.listings.select("league_id", codes.build_code(season, F.col("sport_name")).alias("code"))


@query("x18_comp_level", """
SELECT league_id, CASE source_comp_level WHEN 'Competitive' THEN 'A' WHEN 'High Intermediate' THEN 'B+'
  WHEN 'rec/intermediate' THEN 'B+' WHEN 'Novice' THEN 'D' END AS grade FROM listings""", ("listings",))
def _(t):
    return t.listings.select("league_id", levels.comp_level(F.col("source_comp_level")).alias("grade"))


@query("x19_default_level", """
SELECT league_id, coalesce(source_comp_level, 'None Found') AS source_comp_level, standardized_comp_level
FROM listings_x""", ("listings_x",))
def _(t):
    c = F.col("source_comp_level")
    return t.listings.select("league_id", levels.default_source_level(c).alias("source_comp_level"),
                             levels.standard_level(c).alias("standardized_comp_level"))


@query("x20_listing_type", "SELECT league_id, listing_type FROM listings_x", ("listings_x",))
def _(t):
    return t.listings_x.select("league_id", "listing_type")


@query("x21_side_size_from_url", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (2, 4) AND 1 + o_custkey % 9 <> 1 + o_orderkey % 9 THEN NULL
  WHEN o_orderkey % 6 IN (2, 4) THEN 1 + o_orderkey % 9 WHEN o_orderkey % 6 = 5 THEN NULL ELSE 1 + o_orderkey % 9 END AS side
FROM orders""")
def _(t):
    n, m = 1 + F.col("o_orderkey") % 9, 1 + F.col("o_custkey") % 9
    word = F.element_at(F.array(*[F.lit(w) for w in ("v", "vs", "on", "-v-", "V", "x")]),
                        (F.col("o_orderkey") % 6 + 1).cast("int"))
    other = F.when(F.col("o_orderkey") % 6 % 2 == 0, F.when(F.col("o_orderkey") % 6 == 0, n).otherwise(m)).otherwise(n)
    url = F.concat(F.lit("https://a.com/"), n.cast("string"), word, other.cast("string"), F.lit("-night"))
    return t.table("orders").select("o_orderkey", urls.side_size_from_url(url).alias("side"))


@query("x22_address_parts", """
SELECT venue_id, CASE WHEN address IS NOT NULL THEN trim(string_split(address, ',')[2]) END AS city,
  CASE WHEN address IS NOT NULL THEN split_part(trim(string_split(address, ',')[3]), ' ', 1) END AS province FROM venues""",
       ("venues",))
def _(t):
    a = F.col("address")
    return t.venues.select("venue_id", levels.city_of_address(a).alias("city"), levels.province(a).alias("province"))


@query("x23_search_text_and_fingerprint", """
SELECT query_id, concat(city, ' ', sport, ' league') AS query_text,
  concat(lower(city), '||ca|', lower(sport), '||') AS fingerprint FROM queries""", ("queries",))
def _(t):
    none = F.lit(None).cast("string")
    return t.queries.select(
        "query_id", keys.search_text(F.col("city"), F.col("sport"), F.col("season")).alias("query_text"),
        keys.fingerprint(F.col("city"), none, F.lit("CA"), F.col("sport"), F.col("season"),
                         none.cast("int")).alias("fingerprint"))


@query("x24_url_path", """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS shown FROM pages""")
def _(t):
    return t.table("pages").select("page_id", urls.url_path(F.col("url")).alias("shown"))


@query("x25_sample_ends", """
SELECT doc_id, CASE WHEN length(text) > 60000 THEN concat(left(text, 30000), chr(10), '[...]', chr(10),
    substr(text, (length(text) - 20000) // 2 + 1, 20000), chr(10), '[...]', chr(10), right(text, 10000)) ELSE text END AS long_sample,
  CASE WHEN length(text) > 8000 THEN concat(left(text, 3000), chr(10), '[...]', chr(10),
    substr(text, (length(text) - 3000) // 2 + 1, 3000), chr(10), '[...]', chr(10), right(text, 2000)) ELSE text END AS short_sample
FROM documents""")
def _(t):
    c = F.col("text")
    return t.table("documents").select("doc_id", text.sample_ends(c, 30000, 20000, 10000, 60000).alias("long_sample"),
                                       text.sample_ends(c, 3000, 3000, 2000, 8000).alias("short_sample"))


@query("x26_keep_top_and_bottom", """
WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS words FROM documents)
SELECT doc_id, CASE WHEN len(words) > 200 THEN array_to_string(words[1:150] || words[len(words)-49:], ' ') ELSE text END AS kept
FROM w""")
def _(t):
    return t.table("documents").select("doc_id", text.keep_top_and_bottom(F.col("text"), 200).alias("kept"))


@query("x27_text_size", """
SELECT doc_id, octet_length(encode(text)) AS size_bytes, length(text) // 4 AS token_estimate FROM documents""")
def _(t):
    c = F.col("text")
    return t.table("documents").select("doc_id", text.size_bytes(c).alias("size_bytes"),
                                       text.token_estimate(c).alias("token_estimate"))


@query("s11_parse_lines", """
SELECT doc_id, line FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line
FROM documents) WHERE line <> ''""")
def _(t):
    return t.table("documents").select("doc_id", F.explode(text.parse_lines(F.col("text"))).alias("line"))

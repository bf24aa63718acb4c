"""Queries over page text, page types, elements, tables and links."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, links as link_rules, pages as page_rules, similarity, urls
from ..operators import mining
from .registry import query
from .report_queries import CATEGORY_SQL, SITE_NAV_SQL
from .sql_parts import any_contains, hit_count, sql_text

_DOMAIN = "array_to_string(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[-2:], '.')"


def strip_sql(html, sep):
    s = f"regexp_replace({html}, '<[^>]*>', '{sep}', 'gs')"
    for name, char in page_rules.ENTITIES:
        s = f"replace({s}, {sql_text(name)}, {sql_text(char)})"
    return s


def drop_sql(html, *tags):
    s = f"regexp_replace({html}, '<!--.*?-->', '', 'gs')"
    for t in tags:
        s = f"regexp_replace({s}, '<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'gsi')"
    return s


def collapse_sql(s):
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


TEXT_SQL = collapse_sql(strip_sql(drop_sql("html", "script", "style", "noscript"), " "))
MAIN_TEXT_SQL = collapse_sql("array_to_string(list_filter(list_transform(string_split(" + strip_sql(
    drop_sql("html", "script", "style", "footer"), " ") + ", chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), "
    "lambda s: length(s) >= 3 AND NOT regexp_matches(s, '(?i)copyright|©|all rights reserved|privacy|terms of service') "
    "AND NOT regexp_matches(s, '(?i)^(home|about|contact|login|search)$')), ' ')")


@query("h1_html_to_text", f"SELECT page_id, {TEXT_SQL} AS text FROM pages")
def _(t):
    return t.table("pages").select("page_id", page_rules.html_to_text(F.col("html")).alias("text"))


@query("h2_html_to_main_text", f"SELECT page_id, {MAIN_TEXT_SQL} AS text FROM pages")
def _(t):
    return t.table("pages").select("page_id", page_rules.html_to_main_text(F.col("html")).alias("text"))


_PATHS = [(n, p) for n, ps in fv.PAGE_PATH_PATTERNS.items() for p in ps]


def page_type_sql(source, key, url, html):
    counts = ", ".join(f"{hit_count('txt', ws)} AS n_{n}" for n, ws in fv.PAGE_TEXT_WORDS.items())
    best = "greatest(n_registration, n_schedule, n_standings)"
    return f"""
WITH x AS (SELECT {key} AS id, lower({url}) AS u, lower({strip_sql(html, '')}) AS txt FROM {source}), n AS (SELECT *, {counts} FROM x)
SELECT id AS page_id, CASE {' '.join(f"WHEN contains(u, '{p}') THEN '{n}'" for n, p in _PATHS)} WHEN {best} < 3 THEN 'other'
    {' '.join(f"WHEN n_{n} = {best} THEN '{n}'" for n in fv.PAGE_TEXT_WORDS)} END AS page_type,
  CASE WHEN {any_contains('u', [p for _, p in _PATHS])} THEN 0.85::double WHEN {best} >= 3 THEN 0.7::double ELSE 0.3::double END AS confidence,
  CASE {' '.join(f"WHEN contains(u, '{p}') THEN 'URL matches {n} pattern: {p}'" for n, p in _PATHS)} WHEN {best} < 3 THEN 'No specific page type detected'
    {' '.join(f"WHEN n_{n} = {best} THEN concat(n_{n}, ' {n} keywords')" for n in fv.PAGE_TEXT_WORDS)} END AS reason FROM n"""


@query("h3_page_type", page_type_sql("pages", "page_id", "url", "html"))
def _(t):
    return mining.page_types(t.table("pages"))


@query("h3_page_type_of_site_pages", page_type_sql("site_links", "position + 1000 * site_id", "discovered_url",
                                                   "concat('<p>', anchor_text, '</p> date and time of the game, fee 20, join')"), ("site_links",))
def _(t):
    html = F.concat(F.lit("<p>"), "anchor_text", F.lit("</p> date and time of the game, fee 20, join"))
    return mining.page_types(t.site_links.select((F.col("position") + 1000 * F.col("site_id")).alias("page_id"),
                                                 F.col("discovered_url").alias("url"), html.alias("html")))


def category_sql(source, key, url, html):
    where = f"lower(regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1))"
    text = f"lower({collapse_sql(strip_sql(drop_sql(html, 'script', 'style'), ' '))})"
    scores = []
    for n, p in fv.CATEGORY_PATH_PATTERNS.items():
        found = " + ".join(f"len(regexp_extract_all(txt, '\\b{w}\\b'))" for w in fv.CATEGORY_WORDS[n]) or "0"
        scores.append(f"(CASE WHEN regexp_matches(w, '{p}') THEN 70 ELSE 0 END + least(30, 5 * ({found}))) AS s_{n}")
    best = "greatest(" + ", ".join(f"s_{n}" for n in fv.CATEGORY_PATH_PATTERNS) + ")"
    return f"""
WITH x AS (SELECT {key} AS page_id, {where} AS w, {text} AS txt FROM {source}), s AS (SELECT page_id, {', '.join(scores)} FROM x)
SELECT page_id, CASE WHEN {best} < 20 THEN 'other' {' '.join(f"WHEN s_{n} = {best} THEN '{n}'" for n in fv.CATEGORY_PATH_PATTERNS)} END AS category
FROM s"""


@query("h4_page_category", category_sql("pages", "page_id", "url", "html"))
def _(t):
    return mining.page_categories(t.table("pages")).select("page_id", F.col("page_type").alias("category"))


@query("h4_page_category_of_site_pages", category_sql("site_links", "position + 1000 * site_id", "discovered_url", "concat(anchor_text, ' when the day starts, join, rules and fees, date, match')"), ("site_links",))
def _(t):
    html = F.concat("anchor_text", F.lit(" when the day starts, join, rules and fees, date, match"))
    pages = t.site_links.select((F.col("position") + 1000 * F.col("site_id")).alias("page_id"), F.col("discovered_url").alias("url"), html.alias("html"))
    return mining.page_categories(pages).select("page_id", F.col("page_type").alias("category"))


def table_pages(t):
    """A page per order that lists its lines in a table, with fee and count sentences."""
    row = F.concat(F.lit("<tr><td>"), F.when(F.col("l_linenumber") % 2 == 0, "Monday").otherwise("Tuesday"), F.lit("</td><td>Gym "),
                   F.col("l_suppkey").cast("string"), F.lit("</td><td>$"), F.col("l_quantity").cast("int").cast("string"), F.lit(".50</td></tr>"))
    rows = t.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity", row.alias("r")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["r"]), "")
    html = F.concat(F.lit("<html><body><div class='main'><p>Team fee $1,"), (100 + F.col("l_orderkey") % 900).cast("string"),
                    F.lit(" per team, "), (F.col("l_orderkey") % 70).cast("string"),
                    F.lit(" spots left</p><table><thead><tr><th>Day</th><th>Venue</th><th>Player fee</th></tr></thead><tbody>"), body,
                    F.lit("</tbody></table></div></body></html>"))
    return rows.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("https://www.org-1.com/leagues/"), F.col("l_orderkey").cast("string")).alias("url"),
                       html.alias("html"))


@query("h5_scored_elements")
def _(t):
    return mining.scored_elements(table_pages(t)).select("page_id", "element_order", "tag", "keyword", F.round("score", 4).alias("score"), "element_rank")


@query("h5_page_elements")
def _(t):
    return mining.scored_elements(t.table("pages")).drop("snippet")


@query("h6_price_hints", """
SELECT o_orderkey, n, value, CASE o_orderkey % 3 WHEN 0 THEN 'team_fee' WHEN 1 THEN 'individual_fee' ELSE 'unknown' END AS kind
FROM (SELECT o_orderkey, 0 AS n, (1000 + o_orderkey % 9000)::double + 0.5 AS value FROM orders UNION ALL
      SELECT o_orderkey, 1, (20 + o_orderkey % 7)::double FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    who = F.when(k % 3 == 0, "per Team").when(k % 3 == 1, "per player").otherwise("in all")
    amount = F.concat(F.floor((1000 + k % 9000) / 1000).cast("string"), F.lit(","), F.lpad(((1000 + k % 9000) % 1000).cast("string"), 3, "0"), F.lit(".50"))
    text = F.concat(F.lit("Fee $"), amount, F.lit(" or $ "), (20 + k % 7).cast("string"), F.lit(" "), who)
    rows = t.table("orders").select(k.alias("o_orderkey"), text.alias("text"))
    return rows.select("o_orderkey", F.posexplode(page_rules.prices(F.col("text"))).alias("n", "value"), page_rules.price_kind(F.col("text")).alias("kind"))


@query("h6_price_hints_of_elements")
def _(t):
    return mining.price_hints(mining.scored_elements(table_pages(t)))


@query("h7_page_tables", """
SELECT l_orderkey AS page_id, 0 AS table_index, 'Day|Venue|Player fee' AS headers, count(*) AS data_rows,
  string_agg(CASE WHEN l_linenumber % 2 = 0 THEN 'Monday' ELSE 'Tuesday' END || '|Gym ' || l_suppkey || '|$' || cast(l_quantity AS int) || '.50', ';'
    ORDER BY l_linenumber, l_suppkey, l_quantity) AS cells FROM lineitem GROUP BY l_orderkey""")
def _(t):
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return mining.page_tables(table_pages(t)).select(
        "page_id", "table_index", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("data_rows"), rows.alias("cells"))


@query("h8_team_counts_in_text", """
SELECT o_orderkey AS page_id, unnest(list_filter([o_orderkey % 60, o_orderkey % 7, 12], lambda n: n BETWEEN 1 AND 50)) AS count FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    text = F.concat((k % 60).cast("string"), F.lit(" teams in "), (k % 7).cast("string"), F.lit("divisions, 12 Spots left and 9 courts"))
    return mining.text_count_hints(t.table("orders").select(k.alias("page_id"), text.alias("text"))).select("page_id", "count")


@query("h8_team_counts_in_tables", """
SELECT l_orderkey AS page_id, count(*) AS count FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 50""")
def _(t):
    pages = table_pages(t).withColumn("html", F.replace("html", F.lit("<th>Day</th>"), F.lit("<th>Day of Team</th>")))
    return mining.table_count_hints(pages).select("page_id", "count")


@query("h9_listing_tables", """
SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) - 1 AS row_index, 0.95::double AS confidence,
  CASE WHEN l_linenumber % 2 = 0 THEN 'Monday' ELSE 'Tuesday' END AS day, 'Gym ' || l_suppkey AS venue, '$' || cast(l_quantity AS int) || '.50' AS fee
FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2)""")
def _(t):
    r = F.col("record")
    return mining.listing_rows(mining.page_tables(table_pages(t))).select(
        "page_id", "row_index", "confidence", r["Day"].alias("day"), r["Venue"].alias("venue"), r["Player fee"].alias("fee"))


@query("h10_page_links", "SELECT page_id, position, anchor_text, discovered_url FROM links", ("links",))
def _(t):
    return t.links.select("page_id", "position", "anchor_text", "discovered_url")


def _part(tag):
    return f"len(regexp_extract_all(regexp_extract(html, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1), '<a '))"


@query("h10_link_contexts", f"""
SELECT a.page_id, a.position, a.href, trim({strip_sql('a.anchor_text', '')}) AS anchor_text, CASE WHEN a.position < n.in_nav THEN 'nav'
    WHEN a.position >= n.whole - n.in_footer THEN 'footer' ELSE 'body' END AS context
FROM anchors a JOIN (SELECT page_id, {_part('nav')} AS in_nav, {_part('footer')} AS in_footer, len(regexp_extract_all(html, '<a ')) AS whole FROM pages) n USING (page_id)""",
       ("anchors",))
def _(t):
    return mining.link_contexts(t.table("pages"))


NODE_SQL = "site_id * 1000 + CASE WHEN regexp_matches(source_url, '/n[0-9]+$') THEN regexp_extract(source_url, '/n([0-9]+)$', 1)::bigint ELSE 0 END"


def site_html(t):
    """Each page of the derived sites as HTML; links at odd positions stand in a nav element."""
    node = F.coalesce(F.regexp_extract("source_url", r"/n(\d+)$", 1).try_cast("bigint"), F.lit(0))
    anchor = F.concat(F.lit("<a href='"), "discovered_url", F.lit("'><b>"), "anchor_text", F.lit("</b></a>"))
    part = F.when(F.col("position") % 2 == 1, F.concat(F.lit("<div class='top-nav'><ul><li>"), anchor, F.lit("</li></ul></div>"))).otherwise(
        F.concat(F.lit("<p>"), anchor))
    return (t.site_links.groupBy((F.col("site_id") * 1000 + node).alias("page_id"), F.col("source_url").alias("url"))
            .agg(F.array_sort(F.collect_list(F.struct("position", "discovered_url", part.alias("part")))).alias("parts"))
            .select("page_id", "url", F.concat(F.lit("<html><body>"), F.array_join(F.transform("parts", lambda x: x["part"]), ""),
                                               F.lit("</body></html>")).alias("html")))


_HIGH, _MEDIUM = "|".join(fv.LINK_HIGH_PATTERNS), "|".join(fv.LINK_MEDIUM_PATTERNS)


@query("h10_discovered_links", f"""
WITH x AS (SELECT {NODE_SQL} AS page_id, position, lower(discovered_url) AS u, lower(anchor_text) AS a, discovered_url,
    CASE WHEN position % 2 = 1 THEN 'nav' ELSE 'body' END AS context FROM site_links
  WHERE NOT contains(discovered_url, 'facebook') AND NOT suffix(discovered_url, '.pdf') AND NOT contains(discovered_url, '.com/login')),
s AS (SELECT page_id, discovered_url, context, position, CASE WHEN regexp_matches(u, '{_HIGH}') OR regexp_matches(a, '{_HIGH}') THEN 100
    WHEN regexp_matches(u, '{_MEDIUM}') OR regexp_matches(a, '{_MEDIUM}') THEN 50 ELSE 0 END AS score FROM x)
SELECT page_id, discovered_url, score, context, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, position) AS link_rank FROM s WHERE score > 0""", ("site_links",))
def _(t):
    return mining.discovered_links(site_html(t)).select("page_id", "discovered_url", "score", "context", "link_rank")


@query("h11_three_step_score", f"""
SELECT source_url, position, discovered_url, CASE WHEN regexp_matches(u, '{'|'.join(fv.LINK_HIGH_PATTERNS)}') OR regexp_matches(t, '{'|'.join(fv.LINK_HIGH_PATTERNS)}') THEN 100
  WHEN regexp_matches(u, '{'|'.join(fv.LINK_MEDIUM_PATTERNS)}') OR regexp_matches(t, '{'|'.join(fv.LINK_MEDIUM_PATTERNS)}') THEN 50 ELSE 0 END AS score
FROM (SELECT *, lower(discovered_url) AS u, lower(anchor_text) AS t FROM site_links)""", ("site_links",))
def _(t):
    return t.site_links.select("source_url", "position", "discovered_url",
                               link_rules.three_step_score(F.col("anchor_text"), F.col("discovered_url")).alias("score"))


@query("h12_navigation_score", f"WITH {SITE_NAV_SQL} SELECT source_url, position, discovered_url, score, score >= 100 AS clickable FROM nav", ("site_links",))
def _(t):
    return t.scored_site_links.select("source_url", "position", "discovered_url", "score", "clickable")


@query("h13_rubric_score", f"""
SELECT source_url, position, CASE {' '.join(f"WHEN {any_contains('lower(anchor_text)', fv.RUBRIC_WORDS[p])} THEN {p}" for p in (0, 100, 50, 25))} ELSE 0 END AS score,
  {hit_count('lower(anchor_text)', fv.LISTING_CARD_WORDS)} AS card_words FROM site_links""", ("site_links",))
def _(t):
    c = F.col("anchor_text")
    return t.site_links.select("source_url", "position", link_rules.rubric_score(c).alias("score"), link_rules.card_indicators(c).alias("card_words"))


@query("h14_tab_score")
def _(t):
    return t.site_links.select("source_url", "position", F.round(similarity.tab_score("anchor_text"), 6).alias("score"))


LINK_TYPE_SQL = "CASE " + " ".join(f"WHEN {any_contains('said', ws)} THEN '{n}'" for n, ws in fv.LINK_TYPE_WORDS.items()) + " END"


@query("h15_link_type", f"""
SELECT source_url, position, discovered_url, {LINK_TYPE_SQL} AS page_type FROM (SELECT *, lower(discovered_url || ' ' || anchor_text) AS said FROM site_links)""",
       ("site_links",))
def _(t):
    return t.scored_site_links.select("source_url", "position", "discovered_url", "page_type")


@query("h16_link_category", f"WITH {CATEGORY_SQL} SELECT source_url, position, discovered_url, field_category FROM cat", ("site_links",))
def _(t):
    return t.scored_site_links.select("source_url", "position", "discovered_url", "field_category")


@query("h17_navigation_links", f"""
WITH {SITE_NAV_SQL}, {CATEGORY_SQL}
SELECT n.source_url, n.position, n.discovered_url, n.score, {LINK_TYPE_SQL.replace('said', 'n.said')} AS page_type, c.field_category
FROM nav n JOIN cat c USING (source_url, position, discovered_url, anchor_text) WHERE n.score >= 60""", ("site_links",))
def _(t):
    return mining.navigation_links(t.site_links, 60).select("source_url", "position", "discovered_url", "score", "page_type", "field_category")


def order_trees(t):
    """An accessibility tree per order: a heading, then a list item with a generic link per order line."""
    item = F.struct(F.lit("li").alias("role"), F.lit(None).cast("string").alias("name"), F.array(
        F.struct(F.lit("h3").alias("role"), F.concat(F.lit("Division "), F.col("l_linenumber").cast("string")).alias("name"), F.lit(None).cast("string").alias("url")),
        F.struct(F.lit("a").alias("role"), F.when(F.col("l_linenumber") % 2 == 0, "Learn more").otherwise("Rules").alias("name"),
                 F.concat(F.lit("/part/"), F.col("l_partkey").cast("string")).alias("url"))).alias("children"))
    items = t.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("item")))).alias("items"))
    return items.select(F.col("l_orderkey").alias("page_id"), F.to_json(F.transform("items", lambda x: x["item"])).alias("tree"))


@query("h18_tree_links", """
SELECT l_orderkey AS page_id, CASE WHEN l_linenumber % 2 = 0 THEN 'Division ' || l_linenumber || ' - Learn more' ELSE 'Rules' END AS anchor_text,
  '/part/' || l_partkey AS url FROM lineitem""")
def _(t):
    return mining.tree_links(order_trees(t)).drop("path")


@query("h18_resolved_links", """
SELECT l_orderkey AS page_id, 'https://www.org-' || l_orderkey % 7 || '.com/part/' || l_partkey AS discovered_url FROM lineitem""")
def _(t):
    trees = order_trees(t).withColumn("at", F.concat(F.lit("https://www.org-"), (F.col("page_id") % 7).cast("string"), F.lit(".com/orders/a?b=c")))
    return mining.tree_links(trees, "at").select("page_id", "discovered_url")


@query("h19_role_histogram", """
SELECT role, count(*) AS node_count FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS role FROM pages)
GROUP BY role ORDER BY node_count DESC, role LIMIT 10""")
def _(t):
    return mining.role_histogram(mining.tag_roles(t.table("pages")))


@query("h20_has_team_list", """
SELECT page_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(html,
  '<(?:td|li|div|span)[^>]*>\\s*([A-Z][A-Za-z0-9\\s&''.\\-]{3,40})\\s*</(?:td|li|div|span)>', 1), lambda n: trim(n)), lambda n: length(n) >= 4))) >= 3 AS team_list FROM pages""")
def _(t):
    return t.table("pages").select("page_id", page_rules.has_team_list(F.col("html")).alias("team_list"))


@query("h21_context_bundle")
def _(t):
    out = mining.context_bundle(table_pages(t))
    return out.select("page_id", "page_type", "page_confidence", *[F.to_json(c).alias(c) for c in ("tables", "price_hints", "count_hints", "list_hints")])


def typed_pages(t):
    return mining.page_categories(t.table("pages").withColumn("domain", urls.base_domain(F.col("url"))))


SITE_PAGES_SQL = f"""
kept AS (SELECT page_id, {_DOMAIN.replace('url', 'p.url')} AS domain, c.category AS page_type, p.url, p.html,
    row_number() OVER (PARTITION BY {_DOMAIN.replace('url', 'p.url')} ORDER BY page_id) AS site_rank
  FROM pages p JOIN ({category_sql('pages', 'page_id', 'url', 'html')}) c USING (page_id) QUALIFY site_rank <= 5)"""


@query("h22_text_bundle", f"""
WITH {SITE_PAGES_SQL}, texts AS (SELECT *, {MAIN_TEXT_SQL} AS text FROM kept), n AS (SELECT *, len(string_split(text, ' ')) AS n FROM texts WHERE text <> ''),
s AS (SELECT *, sum(n) OVER (PARTITION BY domain) AS total FROM n),
c AS (SELECT *, greatest(100, floor(n / total * 1000))::int AS share FROM s)
SELECT domain, string_agg(concat(chr(10), '=== ', upper(replace(page_type, '_', ' ')), ' ===', chr(10), chr(10),
    CASE WHEN total > 1000 AND share < n THEN array_to_string(string_split(text, ' ')[1:share], ' ') || ' [truncated]' ELSE text END, chr(10)), chr(10)
  ORDER BY CASE page_type WHEN 'registration' THEN 1 WHEN 'schedule' THEN 2 WHEN 'standings' THEN 3 WHEN 'specific_league' THEN 4 WHEN 'home' THEN 5 ELSE 6 END, url) AS bundle
FROM c GROUP BY domain""")
def _(t):
    kept = mining.pages_by_type(typed_pages(t), "domain", "page_id")
    return mining.text_bundle(kept, "domain", budget=1000)


@query("h23_pages_by_type", f"""
WITH {SITE_PAGES_SQL} SELECT page_id, domain, site_rank, CASE WHEN row_number() OVER (PARTITION BY domain, page_type ORDER BY site_rank) > 1
  THEN page_type || '_' || (site_rank - 1) ELSE page_type END AS slot FROM kept""")
def _(t):
    return mining.pages_by_type(typed_pages(t), "domain", "page_id").select("page_id", "domain", "site_rank", "slot")


@query("h23_pages_by_type_replacing", f"""
WITH {SITE_PAGES_SQL} SELECT page_id, domain, page_type AS slot FROM kept QUALIFY row_number() OVER (PARTITION BY domain, page_type ORDER BY site_rank DESC) = 1""")
def _(t):
    return mining.pages_by_type(typed_pages(t), "domain", "page_id", repeats="replace").select("page_id", "domain", "slot")


@query("h24_find_lines", """
SELECT snapshot_id, line_number, line FROM (SELECT page_id AS snapshot_id, unnest(string_split(html, chr(10))) AS line,
  unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_number FROM pages) WHERE contains(lower(line), 'the')
QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY line_number) <= 50""")
def _(t):
    return mining.find_lines(t.snapshots, "content", "The")

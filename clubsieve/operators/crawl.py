"""Bounded traversal of a stored link table, for all start pages at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, links as link_rules, urls
from ..session import settle, settle_as_laid, settle_by
from .ranking import best_row, top_n
from .reports import category_coverage

SLOTS = 16
OUTPUT = ["start", "url", "parent", "depth", "score", "page_type", "action", "follow"]


def edges_of(links: DataFrame) -> DataFrame:
    """Links in normal form; files are left out."""
    url = urls.normalize_url(F.col("discovered_url"))
    return links.filter(urls.is_fetchable(F.substring_index("discovered_url", "#", 1))).select(
        urls.normalize_url(F.col("source_url")).alias("parent"), "position", url.alias("url"), "anchor_text")


def laid_out(edges: DataFrame) -> DataFrame:
    """The edges once more, settled by parent and slot, so that each level moves its frontier only.

    The links of one page are spread over SLOTS partitions.
    """
    slot = F.pmod(F.xxhash64("url"), F.lit(SLOTS)).cast("int")
    return settle_by(edges.withColumn("slot", slot), "parent", "slot")


def types_of(pages: DataFrame) -> DataFrame:
    """The least type of each page in normal form, settled by URL: every level reads it, none moves it or normalises it."""
    return settle_as_laid(pages.select(urls.normalize_url(F.col("url")).alias("url"), "page_type").groupBy("url").agg(F.min("page_type").alias("page_type")))


def reach(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that leave the frontier (start, parent): each of its rows looks into every slot."""
    every = frontier.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return every.join(edges, ["parent", "slot"]).drop("slot")


def with_score(edges: DataFrame) -> DataFrame:
    """The navigation score, computed only for links that a join has kept."""
    return edges.withColumn("score", link_rules.navigation_score(F.col("url"), F.col("anchor_text")))


def band(score: Column) -> Column:
    return F.when(score >= 100, "high").when(score >= 50, "medium").otherwise("low")


def decide(candidates: DataFrame, pages: DataFrame, from_home: bool, depth: int) -> DataFrame:
    """What to do with each candidate page, by its type and the score of the link to it.

    Links of the start page have passed their own threshold, so only the depth of following
    depends on the score there.
    """
    typed = candidates.join(pages, "url", "left").withColumn("page_type", F.coalesce("page_type", F.lit("OTHER")))
    if from_home:
        deferred = F.col("page_type").isin("SCHEDULE", "MEDIUM_DETAIL")
        out = typed.withColumns({"collect": ~deferred, "defer": deferred,
                                 "follow": ~deferred & ((F.col("page_type") != "LEAGUE_DETAIL") | (F.col("score") >= 100))})
    else:
        table = candidates.sparkSession.createDataFrame(
            list(fv.CRAWL_DECISIONS), "page_type string, band string, collect boolean, follow boolean, defer boolean")
        out = typed.withColumn("band", band(F.col("score"))).join(F.broadcast(table), ["page_type", "band"])
    action = F.when(F.col("collect"), "collect").when(F.col("defer"), "defer").otherwise("skip")
    return out.withColumns({"action": action, "depth": F.lit(depth)}).select(*OUTPUT)


def crawl(starts: DataFrame, links: DataFrame, pages: DataFrame, max_depth: int = 2, min_score: int = 100,
          children: int = fv.CRAWL_CHILDREN_PER_PAGE) -> DataFrame:
    """Pages reached from each start page, level by level, each page once per start.

    Level 1 takes the links of the start page with at least `min_score`. Later levels, `max_depth`
    of them, take the first `children` unvisited links of a followed page that stay on the site,
    are not on the start page and have no negative score. The edges are laid out once; each level is
    one join that moves its frontier only, and is settled in the shared folder, so the plan does not grow with the depth.
    """
    edges = laid_out(edges_of(links))
    types = types_of(pages)
    start = starts.select(urls.normalize_url(F.col("start_url")).alias("start")).distinct()
    first = settle(start.withColumns({"url": F.col("start"), "parent": F.lit(None).cast("string"), "depth": F.lit(0),
                                      "score": F.lit(None).cast("int"), "action": F.lit("collect"), "follow": F.lit(True)})
                   .join(types, "url", "left").select(*OUTPUT))

    on_home = settle(with_score(reach(first.select("start", F.col("url").alias("parent")), edges)))
    home = on_home.filter(urls.same_site(F.col("url"), F.col("start"))).select("start", "url").distinct()
    primary = on_home.filter((F.col("score") >= min_score) & (F.col("url") != F.col("start")))
    level = settle(decide(best_row(primary, ["start", "url"], [F.desc("score"), "position"]), types, True, 1))
    levels = [first, level]
    for depth in range(2, max_depth + 2):
        visited = levels[0].select("start", "url")
        for done in levels[1:]:
            visited = visited.unionByName(done.select("start", "url"))
        found = (reach(level.filter("follow").select("start", F.col("url").alias("parent")), edges)
                 .filter(urls.same_site(F.col("url"), F.col("start")))
                 .join(visited, ["start", "url"], "left_anti").join(home, ["start", "url"], "left_anti"))
        once = best_row(found, ["start", "parent", "url"], ["position"])
        kept = with_score(top_n(once, ["start", "parent"], ["position", "url"], children)).filter("score >= 0")
        chosen = best_row(kept, ["start", "url"], ["parent", "position"])
        level = settle(decide(chosen, types, False, depth))
        levels.append(level)
    out = levels[0]
    for done in levels[1:]:
        out = out.unionByName(done)
    return out


def home_links(starts: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the start pages with score, type and category."""
    start = starts.select(urls.normalize_url(F.col("start_url")).alias("start")).distinct()
    on_home = with_score(start.withColumn("parent", F.col("start")).join(edges_of(links), "parent"))
    kind = link_rules.link_type(F.col("url"), F.col("anchor_text"))
    return on_home.withColumn("page_type", kind).withColumn(
        "field_category", link_rules.link_category(F.col("anchor_text"), F.col("page_type")))


def extra_pages(starts: DataFrame, links: DataFrame, reached: DataFrame, min_score: int = 100, lower_score: int = 60,
                per_category: int = fv.EXTRA_PAGES_PER_CATEGORY) -> DataFrame:
    """Up to three more start-page links, at a lower score, for each category no followed link covers."""
    home = home_links(starts, links)
    by_text = link_rules.link_category(F.col("anchor_text"), F.lit(None).cast("string"))
    used = home.withColumn("field_category", F.when((F.col("score") >= min_score) & (F.col("url") != F.col("start")), by_text))
    uncovered = category_coverage(used, "start").filter("NOT covered").select("start", "field_category")
    fresh = (home.filter(F.col("score") >= lower_score).join(uncovered, ["start", "field_category"], "left_semi")
             .join(reached.select("start", "url"), ["start", "url"], "left_anti"))
    once = best_row(fresh, ["start", "field_category", "url"], [F.desc("score"), "position"])
    return top_n(once, ["start", "field_category"], [F.desc("score"), "position", "url"], per_category, "rank").select(
        "start", "field_category", "url", "score", "rank")


def parent_map(reached: DataFrame) -> DataFrame:
    """Child and parent pages, for the list and detail pages collected below the first level."""
    return reached.filter((F.col("depth") >= 2) & (F.col("action") == "collect")
                          & F.col("page_type").isin("LEAGUE_INDEX", "LEAGUE_DETAIL")).select(
        F.col("url").alias("child_url"), F.col("parent").alias("parent_url"))


def without_home_links(links: DataFrame, home: DataFrame) -> DataFrame:
    """Links of sub-pages less those that the start page of the site already has.

    The start pages' targets, a small part of all, are hashed once each. A sort of both sides would hold in each task as
    many links as fit a partition, which is cut by compressed size, and URLs take many times that in memory.
    """
    known = home.select("site_id", "discovered_url").distinct().hint("shuffle_hash")
    return links.join(known, ["site_id", "discovered_url"], "left_anti")

"""Mining of links, elements, tables and text lines from page HTML."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv, html_tree, links as link_rules, pages as page_rules, urls
from ..functions.text import has_any
from .ranking import best_links, best_row, top_n

ANCHOR = r'<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def anchors(pages: DataFrame) -> DataFrame:
    """One row per plain-text anchor with its position on the page."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), 1).alias("href"),
                         F.regexp_extract_all("html", F.lit(ANCHOR), 2).alias("text"))
    return (pages.select("page_id", F.col("url").alias("source_url"),
                         F.posexplode(pairs).alias("position", "a"))
            .select("page_id", "position", "source_url", F.col("a.href").alias("href"),
                    F.col("a.text").alias("anchor_text")))


def resolve(base, href):
    """Absolute form of a link: full, scheme-relative, root-relative, or relative to the folder."""
    site = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_replace(urls.path(base), r"[^/]*$", "")
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]+:)", 1), href))
            .when(href.startswith("/"), F.concat(site, href))
            .when(href.startswith("#"), F.concat(F.substring_index(base, "#", 1), href))
            .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), href)))


def page_links(pages: DataFrame) -> DataFrame:
    """Anchors of all pages with resolved targets."""
    return anchors(pages).select(
        "page_id", "position", "source_url", F.trim("anchor_text").alias("anchor_text"),
        resolve(F.col("source_url"), F.col("href")).alias("discovered_url"))


def navigation_links(links: DataFrame, min_score: int | None = 100) -> DataFrame:
    """Links with navigation score, type and field category, at or above a score."""
    url, text = F.col("discovered_url"), F.col("anchor_text")
    out = links.withColumn("score", link_rules.navigation_score(url, text)).withColumns({
        "clickable": F.col("score") >= 100, "page_type": link_rules.link_type(url, text)})
    out = out.withColumn("field_category", link_rules.link_category(text, F.col("page_type")))
    return out if min_score is None else out.filter(F.col("score") >= min_score)


def categorised_links(links: DataFrame) -> DataFrame:
    """Links that have a field category, with type and category.

    A filter on the category would be moved below and work out type and category a second time; a list of none or one
    that is exploded is made once.
    """
    text = F.col("anchor_text")
    typed = links.withColumn("page_type", link_rules.link_type(F.col("discovered_url"), text))
    return typed.withColumn("field_category", F.explode(F.array_compact(F.array(link_rules.link_category(text, F.col("page_type"))))))


ELEMENT = pa.struct([("order", pa.int32()), ("tag", pa.string()), ("keyword", pa.string()), *[(c, pa.int32()) for c in ("start", "size", "source", "source_size")]])
TABLES = pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))),
                             ("row_count", pa.int32()), ("text", pa.string())]))
HINT = pa.struct([("type", pa.string()), ("value", pa.float64()), ("source", pa.string())])
#: Characters of HTML whose findings a task holds at a time; a longer page is held alone.
HELD_CHARS = 1 << 20


def lists_of(kind: pa.StructType, pages: int, page: np.ndarray, *columns) -> pa.Array:
    """Rows that come page after page as one Arrow array of lists of structs, a list per page; names as (number, list of names)."""
    ends = pa.array(np.searchsorted(page, np.arange(pages + 1)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
        [pa.array(c[1], f.type).take(pa.array(c[0])) if isinstance(c, tuple) else pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))


def held_pages(batch: pa.RecordBatch):
    """A batch in stretches of rows with so many characters of HTML, each with its HTML as texts."""
    start, held, size = 0, [], 0
    for at in range(0, batch.num_rows, 64):
        for html in batch.column("html").slice(at, 64).to_pylist():
            if held and size + len(html or "") > HELD_CHARS:
                yield batch.slice(start, len(held)), held
                start, held, size = start + len(held), [], 0
            held.append(html)
            size += len(html or "")
    if held:
        yield batch.slice(start, len(held)), held


def parse_pages(pages: DataFrame, elements: bool = True, tables: bool = True, snippet: int = 500, hints: bool = False) -> DataFrame:
    """Per page its text, the elements with a keyword in page order and the tables, from one parse in Arrow batches.

    Where asked for, `price_hints` are the amounts of these elements, best element first, and `untagged` is the HTML without its tags.

    Elements say where their text stands in the page's text and where their source stands in its HTML, so nested
    ones repeat nothing. A page that the parser gives up on keeps what was read till then, and `error` says why.
    Everything after it works on these arrays in place: no shuffle, however large a site is.
    """
    schema = ("page_id bigint, url string, html string, page_text string, "
              "elements array<struct<order: int, tag: string, keyword: string, start: int, size: int, source: int, source_size: int>>, "
              "tables array<struct<headers: array<string>, rows: array<array<string>>, row_count: int, text: string>>, error string")
    if hints:
        schema += ", price_hints array<struct<type: string, value: double, source: string>>, untagged string"

    def tables_of(root):
        return [{"headers": t.headers, "rows": t.rows, "row_count": t.row_count, "text": t.text} for t in html_tree.tables(root)]

    def parse(batches):
        for batch in batches:
            for part, htmls in held_pages(batch):
                of, listed, errors, untagged = html_tree.ElementTexts(), [], [], []
                for html in htmls:  # one page at a time, so that one tree is held at a time
                    p = html_tree.page(html)
                    of.add(p)
                    listed.append(tables_of(p.root) if tables else [])
                    errors.append(p.error)
                    untagged.append(None if html is None else p.untagged)
                columns = {"page_id": part.column("page_id").cast(pa.int64()), "url": part.column("url"), "html": part.column("html"), "page_text": pa.array(of.texts, pa.string())}
                found = html_tree.WordedElements(of, fv.ELEMENT_TAG_WEIGHTS, fv.ELEMENT_WORD_WEIGHTS, longest=snippet) if elements or hints else None
                columns["elements"] = pa.array([[]] * len(htmls), pa.list_(ELEMENT)) if not elements else lists_of(
                    ELEMENT, len(htmls), found.page, found.order, (found.tag, found.tags), (found.word, found.words), found.start, found.size, found.source, found.source_size)
                columns |= {"tables": pa.array(listed, TABLES), "error": pa.array(errors, pa.string())}
                if hints:
                    page, kind, value, tag, word = found.price_hints()
                    sources = [f"{t}.{w}" for t in found.tags for w in found.words]
                    columns["price_hints"] = lists_of(HINT, len(htmls), page, (kind, html_tree.KINDS), value, (tag * len(found.words) + word, sources))
                    columns["untagged"] = pa.array(untagged, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return pages.select("page_id", "url", "html").mapInArrow(parse, schema)


def page_errors(pages: DataFrame) -> DataFrame:
    """(page_id, error) of the pages that could not be read to their end."""
    return parse_pages(pages, elements=False, tables=False).filter(F.col("error").isNotNull()).select("page_id", "error")


def element_text(e: Column, shown: int | None = None) -> Column:
    """Text of an element of parse_pages, all of it or so many characters."""
    return F.substring(F.col("page_text"), e["start"] + 1, e["size"] if shown is None else F.least(e["size"], F.lit(shown)))


def best_elements(elements: Column, longest: int | None = None) -> Column:
    """The elements with a keyword, weighted by their first keyword and their tag, best first; all of them or so many."""
    one_of = lambda c, weights: F.coalesce(*[F.when(c == n, F.lit(x)) for n, x in weights.items()])
    scored = F.transform(elements, lambda e: F.struct(
        (-(one_of(e["keyword"], fv.ELEMENT_WORD_WEIGHTS) * one_of(e["tag"], fv.ELEMENT_TAG_WEIGHTS))).alias("minus_score"), e["order"].alias("element_order"),
        *[e[c].alias(c) for c in ("tag", "keyword", "start", "size", "source", "source_size")]))
    best = F.sort_array(scored)
    return best if longest is None else F.slice(best, 1, longest)


def scored_elements(pages: DataFrame, per_page: int | None = None, shown: int | None = None) -> DataFrame:
    """The elements of each page with a keyword, best first, one row each; limits are elements and characters to show."""
    best = F.posexplode(best_elements(F.col("elements"), per_page)).alias("i", "e")
    return parse_pages(pages, tables=False).select("page_id", "html", "page_text", best).select(
        "page_id", "e.element_order", "e.tag", element_text(F.col("e"), shown).alias("text"), "e.keyword", (-F.col("e.minus_score")).alias("score"),
        (F.col("i") + 1).alias("element_rank"), F.substring(F.col("html"), F.col("e.source") + 1, F.col("e.source_size")).alias("snippet"))


def price_hints(elements: DataFrame) -> DataFrame:
    """Amounts found in elements that carry a price keyword, with the kind of fee."""
    kept = elements.filter(F.col("keyword").isin(*fv.PRICE_WORDS))
    return kept.select("page_id", "element_order", F.posexplode(page_rules.prices(F.col("text"))).alias("n", "value"),
                       page_rules.price_kind(F.col("text")).alias("kind"),
                       F.concat_ws(".", "tag", "keyword").alias("source"))


def with_data(tables: Column) -> Column:
    return F.filter(tables, lambda t: F.size(t["rows"]) > 0)


def page_tables(pages: DataFrame) -> DataFrame:
    """One row per table with data, numbered on its page."""
    return parse_pages(pages, elements=False).select("page_id", F.posexplode(with_data(F.col("tables"))).alias("table_index", "t")).select(
        "page_id", "table_index", "t.headers", "t.rows", "t.row_count", "t.text")


def list_confidence(groups: Column) -> Column:
    return F.round(F.least(0.5 + groups * 0.15, F.lit(0.95)), 2)


def is_listing_table(t: Column, groups: Column | None = None) -> Column:
    """At least two rows, and columns of at least two of the four kinds; their number may be given."""
    return (F.size(t["headers"]) > 0) & (F.size(t["rows"]) >= 2) & ((page_rules.header_groups(t["headers"]) if groups is None else groups) >= 2)


def listing_tables(tables: DataFrame) -> DataFrame:
    """Tables that list records, with the confidence of that reading."""
    whole = F.struct("headers", "rows")
    return tables.filter(is_listing_table(whole)).withColumn(
        "confidence", list_confidence(page_rules.header_groups(F.col("headers"))))


def listing_rows(tables: DataFrame) -> DataFrame:
    """Every row of the listing tables as a map from header to cell.

    Of repeated headers the last column counts. Cells beyond the header row have no name and are left out.
    """
    named = F.arrays_zip(F.slice("headers", F.lit(1), F.least(F.size("headers"), F.size("cells"))).alias("key"),
                         F.slice("cells", F.lit(1), F.least(F.size("headers"), F.size("cells"))).alias("value"))
    keys = F.transform("named", lambda e: e["key"])
    last = F.filter("named", lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["key"]))
    return (listing_tables(tables).select("page_id", "table_index", "confidence", "headers",
                                          F.posexplode("rows").alias("row_index", "cells"))
            .withColumn("named", named)
            .select("page_id", "table_index", "row_index", "confidence", F.map_from_entries(last).alias("record")))


def counts_team_rows(t: Column) -> Column:
    return has_any(F.lower(t["text"]), fv.STANDINGS_TABLE_WORDS) & (t["row_count"] - 1).between(1, 50)


def table_count_hints(pages: DataFrame) -> DataFrame:
    """Team counts read off the number of rows of standings-like tables, header excluded."""
    hits = F.explode(F.filter("tables", counts_team_rows)).alias("t")
    return parse_pages(pages, elements=False).select("page_id", hits).select(
        "page_id", F.lit("standings_table").alias("source"), (F.col("t.row_count") - 1).alias("count"), F.lit(0.85).alias("confidence"))


def text_count_hints(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.select("page_id", F.lit("text_mention").alias("source"),
                        F.explode(page_rules.team_counts(F.col(text))).alias("count"), F.lit(0.7).alias("confidence"))


def context_bundle(pages: DataFrame, shown_tables: int = 3, shown_rows: int = 5) -> DataFrame:
    """Per page: type, the first rows of the first tables, price, count and list hints as nested columns.

    The two limits are for display; the hints come from all tables and whole texts.
    """
    hint = lambda source, n, c: F.struct(F.lit(source).alias("source"), n.alias("count"), F.lit(c).alias("confidence"))
    parsed = parse_pages(pages, elements=False, hints=True).withColumns({"type_text": page_rules.page_type_text_of_untagged(F.col("untagged")), "data": with_data(F.col("tables"))})
    numbered = F.transform("data", lambda t, i: F.struct(i.alias("table_index"), t["headers"].alias("headers"), t["rows"].alias("rows"), page_rules.header_groups(t["headers"]).alias("groups")))
    kind = page_rules.page_type(F.col("url"), F.col("type_text"))
    hints = parsed.select(
        "page_id", kind.alias("kind"), F.transform(F.slice("data", 1, shown_tables), lambda t: F.struct(t["headers"].alias("headers"), F.slice(t["rows"], 1, shown_rows).alias("rows"))).alias("tables"),
        "price_hints",
        F.transform(F.filter("tables", counts_team_rows), lambda t: hint("standings_table", t["row_count"] - 1, 0.85)).alias("table_counts"),
        F.transform(page_rules.team_counts(F.col("type_text")), lambda n: hint("text_mention", n, 0.7)).alias("text_counts"),
        F.transform(F.filter(numbered, lambda t: is_listing_table(t, t["groups"])), lambda t: F.struct(
            t["table_index"].alias("table_index"), t["headers"].alias("headers"), t["rows"].alias("rows"),
            list_confidence(t["groups"]).alias("confidence"))).alias("list_hints"))
    return hints.select(
        "page_id", F.col("kind.page_type").alias("page_type"), F.col("kind.confidence").alias("page_confidence"), "tables", "price_hints",
        F.concat("table_counts", "text_counts").alias("count_hints"), "list_hints")


ANCHORS = pa.schema([("page_id", pa.int64()), ("source_url", pa.string()), ("position", pa.int32()), *[(c, pa.string()) for c in ("href", "anchor_text", "context")]])


def link_contexts(pages: DataFrame, source: Column | None = None) -> DataFrame:
    """Where each anchor stands: footer, nav, header or body, by its nearest five ancestors.

    With a column for the page's URL, it stands beside each anchor as `source_url`.
    """
    def parse(batches):
        for batch in batches:
            for part, htmls in held_pages(batch):
                rows = [(pid, at, i, *a) for pid, at, html in zip(part.column("page_id").to_pylist(), part.column("source_url").to_pylist(), htmls)
                        for i, a in enumerate(html_tree.anchors(html))]
                columns = list(zip(*rows)) or [[]] * len(ANCHORS)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ANCHORS)], schema=ANCHORS)

    kept = pages.select("page_id", (F.lit(None) if source is None else source).cast("string").alias("source_url"), "html")
    found = kept.mapInArrow(parse, "page_id bigint, source_url string, position int, href string, anchor_text string, context string")
    return found.drop("source_url") if source is None else found


def discovered_links(pages: DataFrame, min_score: int = 1, per_page: int = 20) -> DataFrame:
    """Anchors worth recording: allowed targets with a score, once per target, best first."""
    found = link_contexts(pages, F.col("url")).filter(F.trim("href") != "")
    target = resolve(F.col("source_url"), F.trim("href"))
    kept = found.withColumn("discovered_url", target).filter(
        link_rules.may_visit(F.col("discovered_url"), F.col("source_url")))
    scored = kept.withColumn("score", link_rules.three_step_score(F.col("anchor_text"), F.col("discovered_url")))
    return best_links(scored.filter(F.col("score") >= min_score), per_page)


def tree_nodes(trees: DataFrame) -> DataFrame:
    """Nodes of JSON accessibility trees: path, parent path, role, name and url."""
    schema = "page_id bigint, path string, parent string, sibling int, role string, name string, url string"

    def parse(batches):
        for pdf in batches:
            rows = [(pid, *n) for pid, tree in zip(pdf["page_id"], pdf["tree"]) for n in html_tree.flatten(tree)]
            yield pd.DataFrame(rows, columns=["page_id", "path", "parent", "sibling", "role", "name", "url"])

    return trees.select("page_id", "tree").mapInPandas(parse, schema)


def tree_links(trees: DataFrame, page_url: str | None = None) -> DataFrame:
    """Links of the trees; a generic anchor takes the nearest heading or label among its
    siblings, then among those of its ancestors, three levels in all.

    With the name of the column that holds the page's URL, `discovered_url` is the target resolved against it.
    Trees that are null or cannot be read have no links, see tree_errors.
    """
    def parse(batches):
        for pdf in batches:
            rows = [(pid, base, *link) for pid, base, tree in zip(pdf["page_id"], pdf["base"], pdf["tree"]) for link in html_tree.tree_links(tree)]
            yield pd.DataFrame(rows, columns=["page_id", "base", "path", "anchor_text", "url"])

    base = F.lit(None).cast("string") if page_url is None else F.col(page_url)
    found = trees.select("page_id", base.alias("base"), "tree").mapInPandas(parse, "page_id bigint, base string, path string, anchor_text string, url string")
    if page_url is None:
        return found.drop("base")
    whole = F.col("url").rlike("^https?://") | F.col("base").isNull()
    return found.withColumn("discovered_url", F.when(whole, F.col("url")).otherwise(resolve(F.col("base"), F.col("url")))).drop("base")


def tree_errors(trees: DataFrame) -> DataFrame:
    """(page_id, error) of the trees that cannot be read."""
    def parse(batches):
        for pdf in batches:
            rows = [(pid, error) for pid, tree in zip(pdf["page_id"], pdf["tree"]) if (error := html_tree.load_tree(tree)[1])]
            yield pd.DataFrame(rows, columns=["page_id", "error"])

    return trees.select("page_id", "tree").mapInPandas(parse, "page_id bigint, error string")


def role_histogram(nodes: DataFrame, limit: int = 10) -> DataFrame:
    return (nodes.groupBy("role").agg(F.count("*").alias("node_count"))
            .orderBy(F.desc("node_count"), "role").limit(limit))


def tag_roles(pages: DataFrame) -> DataFrame:
    """Tag names of a page as roles, one row per opening tag."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), 1)).alias("role"))


def pages_by_type(pages: DataFrame, site: str, order: str, per_site: int = 5, repeats: str = "number") -> DataFrame:
    """The first pages of each site with a slot per type.

    A repeated type either gets a numbered slot or replaces the earlier page of that type.
    """
    kept = top_n(pages, site, [order], per_site, "site_rank")
    if repeats == "replace":
        return best_row(kept, [site, "page_type"], [F.desc("site_rank")]).withColumn("slot", F.col("page_type"))
    inside = Window.partitionBy(site, "page_type").orderBy("site_rank")
    again = F.row_number().over(inside) > 1
    return kept.withColumn("slot", F.when(again, F.concat_ws("_", "page_type", (F.col("site_rank") - 1).cast("string")))
                           .otherwise(F.col("page_type")))


def text_bundle(pages: DataFrame, site: str, budget: int = 12000, least: int = 100) -> DataFrame:
    """The kept pages of a site as one text under headers, each cut to its share of a word budget.

    Takes the output of pages_by_type, so a site has a fixed number of pages.
    """
    text = page_rules.html_to_main_text(F.col("html"))
    rows = pages.withColumn("text", text).filter(F.col("text") != "")
    words = F.split("text", " ")
    total = F.sum("n").over(Window.partitionBy(site))
    share = F.greatest(F.lit(least), F.floor(F.col("n") / F.col("total") * budget)).cast("int")
    cut = F.when((F.col("total") > budget) & (share < F.col("n")),
                 F.concat(F.array_join(F.slice(F.col("words"), F.lit(1), share), " "), F.lit(" [truncated]"))).otherwise(F.col("text"))
    order = F.coalesce(*[F.when(F.col("page_type") == k, F.lit(v)) for k, v in fv.BUNDLE_PRIORITY.items()], F.lit(99))
    header = F.concat(F.lit("\n=== "), F.upper(F.replace("page_type", F.lit("_"), F.lit(" "))), F.lit(" ===\n"))
    part = F.concat(header, F.lit("\n"), F.col("cut"), F.lit("\n"))
    return (rows.withColumns({"words": words, "n": F.size(words)}).withColumn("total", total).withColumn("cut", cut)
            .groupBy(site).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
                order.alias("order"), "url", part.alias("part")))), lambda x: x["part"]), "\n").alias("bundle")))


def find_lines(pages: DataFrame, content: str, text: str, limit: int = 50) -> DataFrame:
    """Lines with a text in any case, as page and line number; the first `limit` per page."""
    lines = pages.select("snapshot_id", F.posexplode(F.split(content, "\n")).alias("i", "line")).filter(
        F.lower("line").contains(text.lower()))
    return top_n(lines.select("snapshot_id", (F.col("i") + 1).alias("line_number"), "line"), "snapshot_id",
                 ["line_number"], limit)


def page_types(pages: DataFrame) -> DataFrame:
    """Page type, confidence and reason of every page."""
    return (pages.select("page_id", "url", page_rules.page_type_text(F.col("html")).alias("text"))
            .select("page_id", page_rules.page_type(F.col("url"), F.col("text")).alias("k")).select("page_id", "k.*"))


def page_categories(pages: DataFrame) -> DataFrame:
    """The pages with their category."""
    return (pages.withColumn("_text", page_rules.category_text(F.col("html")))
            .withColumn("page_type", page_rules.page_category(F.col("url"), F.col("_text"))).drop("_text"))

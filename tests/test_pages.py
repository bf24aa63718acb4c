"""Page parsing: nesting, tables, contexts, trees and hints on small pages."""
import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from clubsieve.functions import fixed_values as fv, html_tree, pages as page_rules
from clubsieve.operators import mining
from clubsieve.sources import responses

PAGE = """<html><body><header><a href="/top">Top</a></header>
<div class="Main-Nav"><ul><li><span><a href="x/y"> Leagues <b>now</b></a></span></li></ul></div>
<p>Team fee: $1,250.00<p>Unclosed paragraph with cost 20
<table><thead><tr><th>Day</th><th>Venue</th><th>Team Fee</th></tr></thead>
<tbody><tr><td>Monday</td><td>Gym <i>A</i></td><td>$300</td></tr><tr><td></td><td> </td></tr><tr><td>Friday</td><td>Park</td><td>$280</td></tr></tbody></table>
<table><tr><th>Rank</th><th>Team</th></tr><tr><td>1</td><td>Hawks</td></tr><tr><td>2</td><td>Jets</td></tr></table>
<table><tr><td>plain</td></tr></table>
<footer><div><a href="mailto:x@y.z">Mail</a></div></footer><script>var a = "<table><tr><td>no</td></tr></table>";</script></body></html>"""


def pages_of(spark, *html):
    return spark.createDataFrame([(i, "https://www.acme.com/a/b", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")


def test_anchor_contexts():
    assert html_tree.anchors(PAGE) == [("/top", "Top", "header"), ("x/y", "Leaguesnow", "nav"), ("mailto:x@y.z", "Mail", "footer")]


def test_tables(spark):
    rows = mining.page_tables(pages_of(spark, PAGE)).orderBy("table_index").collect()
    assert [(r.headers, r.rows) for r in rows] == [
        (["Day", "Venue", "Team Fee"], [["Monday", "GymA", "$300"], ["Friday", "Park", "$280"]]),
        (["Rank", "Team"], [["1", "Hawks"], ["2", "Jets"]]), ([], [["plain"]])]
    listed = mining.listing_rows(mining.page_tables(pages_of(spark, PAGE))).orderBy("row_index").collect()
    assert [(r.table_index, r.confidence, r.record) for r in listed] == [
        (0, 0.95, {"Day": "Monday", "Venue": "GymA", "Team Fee": "$300"}), (0, 0.95, {"Day": "Friday", "Venue": "Park", "Team Fee": "$280"})]


def test_team_counts(spark):
    got = mining.table_count_hints(pages_of(spark, PAGE)).collect()
    assert sorted(r["count"] for r in got) == [2, 3]  # "Team Fee" and "Rank/Team" tables, header excluded


def test_scored_elements(spark):
    got = mining.scored_elements(pages_of(spark, PAGE)).orderBy("element_rank").collect()
    first = got[0]
    assert (first.tag, first.keyword, round(first.score, 3)) == ("table", "team fee", 1.2)
    paragraph = next(r for r in got if r.tag == "p" and r.keyword == "team fee")
    assert paragraph.text == "Team fee: $1,250.00" and round(paragraph.score, 3) == 0.48
    assert len(got) <= 20
    prices = mining.price_hints(mining.scored_elements(pages_of(spark, PAGE))).filter("source = 'p.team fee'").collect()
    assert [(r.kind, r.value) for r in prices] == [("team_fee", 1250.0)]


def test_context_bundle(spark):
    row = mining.context_bundle(pages_of(spark, PAGE)).first()
    assert [t.headers for t in row.tables] == [["Day", "Venue", "Team Fee"], ["Rank", "Team"], []]
    assert {h.source for h in row.count_hints} == {"standings_table"} and len(row.list_hints) == 1
    assert row.page_type == "other"


def test_discovered_links(spark):
    html = ('<a href="/register">Go</a><a href="/register">Register now</a><a href="https://x.acme.com/teams">T</a><a href="/a.pdf">Schedule</a>'
            '<a href="https://other.com/schedule">S</a><a href="/login/schedule">L</a><a href="#season">S</a><a href="zzz">nothing</a><a href="">E</a>')
    got = mining.discovered_links(pages_of(spark, html)).orderBy("link_rank").collect()
    assert [(r.discovered_url, r.score) for r in got] == [
        ("https://www.acme.com/register", 100), ("https://www.acme.com/a/b#season", 100), ("https://x.acme.com/teams", 50)]


def test_tree_links(spark):
    tree = [{"role": "h2", "name": "Indoor"},
            {"role": "div", "children": [{"role": "text", "name": "Details"}, {"role": "li", "children": [{"role": "a", "name": "Learn more", "url": "/x"}]}]},
            {"role": "section", "children": [{"role": "h3", "name": "Beach"}, {"role": "link", "name": "click here", "url": "/y"}, {"role": "a", "name": "Rules", "url": "/r"},
                                             {"role": "a", "name": "No url"}]}]
    df = spark.createDataFrame([(1, json.dumps(tree))], "page_id bigint, tree string")
    assert [(r.anchor_text, r.url) for r in mining.tree_links(df).orderBy("url").collect()] == [
        ("Rules", "/r"), ("Indoor - Learn more", "/x"), ("Beach - click here", "/y")]
    nodes = mining.tree_nodes(df)
    assert nodes.count() == 10 and nodes.filter("parent = '0'").count() == 3


def test_pages_by_type_slots(spark):
    rows = [(i, "s", t) for i, t in enumerate(["home", "schedule", "home", "home", "other", "schedule"])]
    df = spark.createDataFrame(rows, "page_id bigint, site string, page_type string")
    got = {r.page_id: r.slot for r in mining.pages_by_type(df, "site", "page_id").collect()}
    assert got == {0: "home", 1: "schedule", 2: "home_2", 3: "home_3", 4: "other"}
    got = {r.page_id for r in mining.pages_by_type(df, "site", "page_id", repeats="replace").collect()}
    assert got == {3, 1, 4}


def test_text_bundle(spark):
    long = " ".join(["word"] * 900)
    rows = [(1, "s", "https://s/1", "other", f"<p>{long}</p>"), (2, "s", "https://s/2", "registration", "<p>Join us here</p>"), (3, "s", "https://s/3", "home", "<p></p>")]
    df = spark.createDataFrame(rows, "page_id bigint, site string, url string, page_type string, html string")
    text = mining.text_bundle(df, "site", budget=300).first().bundle
    assert text.startswith("\n=== REGISTRATION ===\n\nJoin us here\n") and text.count("word") == 299 and "[truncated]" in text
    assert mining.text_bundle(df, "site", budget=5000).first().bundle.count("word") == 900


def test_extraction_responses(spark):
    good = '{"leagues": [{"a": "x", "n": 1}, {"a": "y", "n": 2}]}'
    cases = {1: good, 2: f"Sure:\n```json\n{good}\n```", 3: '{"leagues": {"a": "x", "n": 1}}', 4: '[{"a": "x", "n": 1}]',
             5: '{"leagues": [{"a": "x", "n": 1}, {"a": "y", "z": {}, "n"', 9: '{"leagues": [{"a": "x", "n": 1}, {"a": "y", "n"', 6: "no json", 7: None, 8: '{"a": "x", "n": 1}'}
    df = spark.createDataFrame(list(cases.items()), "k int, t string")
    got = responses.extracted_records(df, "t", "a string, n int", ["k"]).groupBy("k").agg(F.sort_array(F.collect_list("a")).alias("a")).collect()
    assert {r.k: r.a for r in got} == {1: ["x", "y"], 2: ["x", "y"], 3: ["x"], 4: ["x"], 5: ["x"]}


def test_deep_nesting_and_repeated_headers(spark):
    from clubsieve.functions import html_tree
    deep = html_tree.parse("<div>" * 5000 + "end" + "</div>" * 5000)
    assert deep.text == deep.raw_text == "end" and len(html_tree.elements(deep, {"div"})) == 5000
    html = ("<table><tr><th>Team</th><th>Day</th><th>Fee</th><th>Fee</th><th></th><th></th></tr>"
            + "".join(f"<tr><td>t{i}</td><td>Mon</td><td>{i}</td><td>{i + 1}</td><td>a</td><td>b</td></tr>" for i in range(4)) + "</table>")
    tables = spark.createDataFrame([(1, 0, ["Team", "Day", "Fee", "Fee", "", ""], [["t", "Mon", "1", "2", "a", "b", "spare"]])],
                                   "page_id bigint, table_index int, headers array<string>, rows array<array<string>>")
    from clubsieve.operators import mining
    keep = mining.listing_tables
    mining.listing_tables = lambda t: t.selectExpr("*", "0.9 AS confidence")
    try:
        record = mining.listing_rows(tables).collect()[0].record
    finally:
        mining.listing_tables = keep
    assert record == {"Team": "t", "Day": "Mon", "Fee": "2", "": "b"} and html_tree.tables(html_tree.parse(html))[0].headers[2:4] == ["Fee", "Fee"]


def test_prices_of_late_elements_and_long_texts(spark):
    """A price behind 5000 characters and one in the 30th element with a keyword count like any other."""
    html = ("<p>Team fee " + "word " * 1000 + "$77.00</p>" + "<p>The cost is shown below</p>" * 40 + "<p>Cost $55.00</p>")
    got = {r.value for r in mining.price_hints(mining.scored_elements(pages_of(spark, html))).collect()}
    assert got == {77.0, 55.0}
    bundle = mining.context_bundle(pages_of(spark, html)).first()
    assert {p.value for p in bundle.price_hints} == {77.0, 55.0}
    assert mining.scored_elements(pages_of(spark, html), per_page=20, shown=200).agg({"element_rank": "max"}).first()[0] == 20


BAD_PAGES = ["<![x[", "<p>Team fee one</p><![x[<p>after", "<![CDATA[<p>x</p>]]><p>Team fee two</p>", "<![if IE]><p>Team fee</p><![endif]>", "<!", "<!-", "<!--", "<!doctype", "<!DOCTYPE [", "<?php",
             "<", "</", "</ >", "<a", '<a href="', "<a href=x", "&#x;&#99999999999;", "<p" * 500, "\0<b>\0", "<table><tr><td>Fee", "<script><p>Team fee", "</p></div></table>", "<![ [", "<!ELEMENT br EMPTY>", ""]


def test_bad_pages_do_not_end_the_job(spark):
    rows = [(i, "https://a.com/", h) for i, h in enumerate([*BAD_PAGES, None])] + [(99, "https://a.com/", "<p>Team fee $9.00</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert mining.parse_pages(df).count() == len(rows)
    kept = {r.page_id: r.text for r in mining.scored_elements(df).collect()}
    assert kept[1] == "Team fee one" and kept[2] == "Team fee two" and kept[99] == "Team fee $9.00"
    for found in (mining.page_tables(df), mining.link_contexts(df), mining.context_bundle(df), mining.table_count_hints(df), mining.page_errors(df)):
        found.collect()


def test_what_the_parser_gives_up_on_is_named(spark, monkeypatch):
    def fail(self, tag):
        raise AssertionError("no such end")

    monkeypatch.setattr(html_tree._Builder, "handle_endtag", fail)
    page = html_tree.page("<p>Team fee</p><p>more</p>")
    assert page.text == "Team fee" and "no such end" in page.error and page.root.children[0].text_end == 8


def test_element_texts_are_stretches_of_the_page(spark):
    html = "<div> Team <b>Fee</b><table><tr><td>a</td><td> $5 </td></table><script>fee</script></div><p>Cost<div>price<br>x<img src=y>z"
    page = html_tree.page(html)
    for n in page.root.walk():
        assert n.text == page.text[n.text_start:n.text_end if n.text_end >= 0 else None]
        assert n.tag == "" or html[n.start:n.end].startswith("<" + n.tag)


def test_nested_elements_do_not_repeat_their_text(spark):
    html = "<div>" * 2000 + "Team fee " + "word " * 12_000 + "</div>" * 2000
    rows = mining.parse_pages(pages_of(spark, html)).select("elements", "page_text").collect()[0]
    assert len(rows.elements) == 2000 and len(rows.page_text) + 60 * len(rows.elements) < 1_000_000
    assert mining.scored_elements(pages_of(spark, html)).select("page_id").count() == 2000


def test_bad_trees(spark):
    link = {"role": "a", "name": "Rules", "url": "/r"}
    deep = link
    for _ in range(1500):
        deep = {"role": "div", "children": [deep]}
    trees = [None, "{not json", "[" * 100_000, json.dumps(deep), json.dumps(["text", 5, None, link, [link]]), json.dumps({"role": "a", "name": None, "url": 7, "children": "x"}), "3", json.dumps(link)]
    df = spark.createDataFrame([(i, "https://a.com/b/c?d", t) for i, t in enumerate(trees)], "page_id bigint, url string, tree string")
    found = sorted((r.page_id, r.discovered_url) for r in mining.tree_links(df, "url").collect())
    assert found == [(i, "https://a.com/r") for i in (3, 4, 4, 7)]
    assert mining.tree_nodes(df).where("page_id = 3").count() == 1501
    assert sorted(r.page_id for r in mining.tree_errors(df).collect()) == [1, 2]


def test_plain_markup_is_read_as_the_parser_reads_it():
    pieces = ["<p>", "</p>", "<div class='nav x'>", "</div>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<br>", "<li>", "Team fee ", "\n cost $5 ",
              "<a href='/q'>", "</a>", "<a href=\"u\"\n href='v' >", "<!-- c -->", "<!DOCTYPE html>", "<script>var a</script>", "<title>t</title>", "<title>", " > "]
    odd = ["<", "&amp;", "<br/>", "</p >", "<P>", "<a href=x>", "<!-->", "<input disabled>", "</td a='b'>"]
    shown = lambda b: (b.error, b.found.stripped, [(n.tag, n.tag and n.attrs, n.start, n.end, n.text_start, n.text_end, n.raw_text) for n in html_tree.Node(b.found, 0).walk()])
    rnd, quick = random.Random(3), 0
    for i in range(4000):
        html = "".join(rnd.choice(pieces if i % 2 or rnd.random() < 0.9 else odd) for _ in range(rnd.randrange(1, 30)))
        quick += html_tree._plain(html) is not None
        assert shown(html_tree._Builder(html)) == shown(html_tree._Builder(html, quick=False)), html
    assert quick > 1000


def test_a_task_holds_few_pages_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(mining, "HELD_CHARS", 100)
    htmls = ["<p>Team fee $1</p>", None, "<p>" + "x" * 300 + "</p>", "", "<p>cost</p>"] * 30
    batch = pa.RecordBatch.from_pydict({"html": htmls})
    parts = list(mining.held_pages(batch))
    assert [h for part, held in parts for h in held] == htmls == [h for part, held in parts for h in part.column("html").to_pylist()]
    assert all(len(held) == 1 or sum(len(h or "") for h in held) <= 100 for _, held in parts)


def test_a_bundle_reads_each_page_once(spark):
    plan = mining.context_bundle(pages_of(spark, PAGE))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    plan = mining.discovered_links(pages_of(spark, PAGE))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_hints_of_a_bundle_are_those_of_its_elements(spark):
    """Elements that begin or end inside an amount, as texts are joined without a space, take their own part of it."""
    pieces = ["<p>", "</p>", "<div class='nav x'>", "</div>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<span>", "</span>", "<b>", "</b>", "Team fee ", "COST ", "$", "12", "3,456.7", ",234",
              ".50", "5 Teams", "player", "İndividual price", "é", "９", " > ", "&amp;", "<script>fee 1</script>", "<!-- 7 -->"]
    rnd = random.Random(5)
    htmls = ["<div>Team fee $1<span>2 cost</span></div>", None, *BAD_PAGES, *["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]]
    df = pages_of(spark, *htmls)
    scored = mining.scored_elements(df)
    hints = mining.price_hints(scored).join(scored.select("page_id", "element_order", "element_rank"), ["page_id", "element_order"])
    wanted = {i: [] for i in range(len(htmls))}
    for r in sorted(hints.collect(), key=lambda r: (r.page_id, r.element_rank, r.n)):
        wanted[r.page_id].append((r.kind, r.value, r.source))
    got = {r.page_id: [(h.type, h.value, h.source) for h in r.price_hints] for r in mining.context_bundle(df).collect()}
    assert got == wanted and sum(map(len, got.values())) > 500 and got[0] == [("team_fee", 12.0, "div.team fee"), ("unknown", 2.0, "span.cost")]
    types = {r.page_id: (r.page_type, r.confidence) for r in mining.page_types(df).collect()}
    assert {r.page_id: (r.page_type, r.page_confidence) for r in mining.context_bundle(df).collect()} == types
    of = mining.parse_pages(df, hints=True).select(page_rules.page_type_text(F.col("html")).alias("a"), page_rules.page_type_text_of_untagged(F.col("untagged")).alias("b"))
    assert [r for r in of.collect() if r.a != r.b] == []


def test_a_bundle_searches_texts_once(spark):
    """Elements lie in each other: a search of each one's text for its amounts, and again for each amount, grew with the square of a table's rows."""
    plan = mining.context_bundle(pages_of(spark, PAGE))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(page_text" not in plan


def test_page_type_by_words(spark):
    words = fv.PAGE_TEXT_WORDS
    texts = [" ".join(words[a][:n] + words[b][:m]) for a in words for b in words for n in (0, 2, 3, 8) for m in (0, 2, 3, 8)] + [None, ""]
    df = spark.createDataFrame([(t, u) for t in texts for u in ("https://a.com/", "https://a.com/Games/register", None)], "t string, u string")
    for r in df.select("t", "u", page_rules.page_type(F.col("u"), F.col("t")).alias("k")).collect():
        counts = {name: sum(w in (r.t or "") for w in ws) for name, ws in words.items()}
        best = max(counts, key=counts.get)
        paths = [(n, p) for n, ps in fv.PAGE_PATH_PATTERNS.items() for p in ps if p in (r.u or "").lower()]
        if paths:
            assert tuple(r.k) == (paths[0][0], 0.85, f"URL matches {paths[0][0]} pattern: {paths[0][1]}")
        elif counts[best] >= 3:
            assert tuple(r.k) == (best, 0.7, f"{counts[best]} {best} keywords")
        else:
            assert tuple(r.k) == ("other", 0.3, "No specific page type detected")

"""Bounded traversal on a small site."""
from clubsieve.operators import crawl

LINKS = "source_url string, position int, discovered_url string, anchor_text string"
H = "https://www.a.com/"


def run(spark, links, types, **options):
    pages = spark.createDataFrame([(u, t) for u, t in types.items()], "url string, page_type string")
    starts = spark.createDataFrame([(H,)], "start_url string")
    rows = [(s, i, d, t) for i, (s, d, t) in enumerate(links)]
    return crawl.crawl(starts, spark.createDataFrame(rows, LINKS), pages, **options)


def test_decisions_and_depth(spark):
    links = [(H, "https://a.com/leagues", "Leagues"), (H, "https://a.com/about", "About us"), (H, "https://a.com/pool", "Swim league"),
             (H, "https://a.com/schedule/", "Schedule"),
             ("https://a.com/leagues", "http://www.a.com/d1#x", "Division 1"), ("https://a.com/leagues", "https://a.com/about", "Teams"),
             ("https://a.com/leagues", "https://other.com/league", "League"), ("https://a.com/leagues", "https://a.com/rules.pdf", "Rules"),
             ("https://a.com/leagues", "https://a.com/misc", "Misc"), ("https://a.com/leagues", "https://a.com/kids", "Kids camp"),
             ("https://a.com/d1", "https://a.com/d2", "Season 2"), ("https://a.com/d2", "https://a.com/d3", "Season 3"), ("https://a.com/d1", H, "Home league")]
    types = {H: "OTHER", "https://a.com/leagues": "LEAGUE_INDEX", "https://a.com/schedule": "SCHEDULE", "https://a.com/d1": "LEAGUE_DETAIL",
             "https://a.com/d2": "MEDIUM_DETAIL", "https://a.com/d3": "LEAGUE_DETAIL"}
    out = run(spark, links, types)
    got = {r.url: (r.depth, r.action, r.parent) for r in out.collect()}
    assert got == {
        "https://a.com/": (0, "collect", None), "https://a.com/leagues": (1, "collect", "https://a.com/"),
        "https://a.com/schedule": (1, "defer", "https://a.com/"), "https://a.com/d1": (2, "collect", "https://a.com/leagues"),
        "https://a.com/misc": (2, "skip", "https://a.com/leagues"), "https://a.com/d2": (3, "defer", "https://a.com/d1")}
    assert [tuple(r) for r in crawl.parent_map(out).collect()] == [("https://a.com/d1", "https://a.com/leagues")]


def test_children_cap(spark):
    links = [(H, "https://a.com/leagues", "Leagues")] + [("https://a.com/leagues", f"https://a.com/d{i}", "Division") for i in range(50)]
    out = run(spark, links, {"https://a.com/leagues": "LEAGUE_INDEX"})
    assert {r.url for r in out.filter("depth = 2").collect()} == {f"https://a.com/d{i}" for i in range(30)}


def test_no_page_twice_and_depth_limit(spark):
    links = [(H, "https://a.com/n0", "League")]
    links += [(f"https://a.com/n{i}", f"https://a.com/n{j}", "League") for i in range(8) for j in (i + 1, max(0, i - 1), 0)]
    out = run(spark, links, {f"https://a.com/n{i}": "LEAGUE_INDEX" for i in range(9)}, max_depth=4)
    rows = out.collect()
    assert len({r.url for r in rows}) == len(rows) and max(r.depth for r in rows) == 5


def test_extra_pages(spark):
    links = [(H, "https://a.com/leagues", "Leagues")] + [(H, f"https://a.com/login/v{i}", f"League venue {i}") for i in range(5)]
    starts = spark.createDataFrame([(H,)], "start_url string")
    rows = spark.createDataFrame([(s, i, d, t) for i, (s, d, t) in enumerate(links)], LINKS)
    reached = run(spark, links, {})
    got = crawl.extra_pages(starts, rows, reached, lower_score=50).orderBy("rank").collect()
    assert [(r.field_category, r.url, r.score) for r in got] == [("VENUE", f"https://a.com/login/v{i}", 50) for i in range(3)]


def test_links_without_home_links_are_not_sorted(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, "b")], "site_id bigint, discovered_url string")
    home = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "site_id bigint, discovered_url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = crawl.without_home_links(links, home)
        assert "ShuffledHashJoin" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Sort" not in plan
        assert sorted(map(tuple, out.collect())) == [(1, "b"), (1, "b"), (2, "a")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_page_types_are_settled_by_url_and_not_moved_again(spark):
    pages = spark.createDataFrame([("https://www.a.com/x/", "SCHEDULE"), ("https://a.com/x", "OTHER"), ("https://a.com/", None)], "url string, page_type string")
    types = crawl.types_of(pages)
    assert {tuple(r) for r in types.collect()} == {("https://a.com/x", "OTHER"), ("https://a.com/", None)}
    candidates = spark.range(100).selectExpr("concat('https://a.com/', id) AS url")
    plan = candidates.join(types.hint("merge"), "url", "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "regexp" not in plan

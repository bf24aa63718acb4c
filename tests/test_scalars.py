"""Case tables for the scalar functions, worked by hand from the rules."""
import pytest
from pyspark.sql import functions as F

from clubsieve.functions import codes, keys, levels, links, pages, screening, text, urls


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[1] for r in df.select("i", fn(F.col("x"))).orderBy("i").collect()]


CASES = {
    "canonical": (urls.canonicalize_url, {
        "HTTP://WWW.Acme.com/Page/": "https://acme.com/page", "https://a.com/?utm_source=x": "https://a.com/",
        "https://a.com/p?utm_x=1&b=2": "https://a.com/p&b=2", "https://a.com/p?a=1&fbclid=9": "https://a.com/p?a=1", None: ""}),
    "normal": (urls.normalize_url, {
        "http://www.a.com": "https://a.com/", "http://a.com/x//#top": "https://a.com/x", "https://wow.com/p?q=1#f": "https://wow.com/p?q=1"}),
    "base_domain": (urls.base_domain, {
        "https://www.acme.com/x": "acme.com", "https://reg.acme.com:8080/p": "acme.com", "http://192.168.0.1/x": "192.168.0.1",
        "acme.co.uk": "co.uk", "Acme.COM/path": "acme.com", "localhost": "localhost", None: "", "": ""}),
    "city": (urls.city_from_url, {
        "https://a.com/calgary/vball": "Calgary", "a.com/north-york-volleyball": "North York", "https://ottawa.com/x": None,
        "https://a.com/x/LA/": "Los Angeles", "https://a.com/lakes": None, "https://a.com/quebec-city": "Quebec City",
        "https://a.com/quebec-city-spring": "Quebec City", "https://a.com/niagara-falls-x": "Niagara", "https://a.com/niagara-falls": "Niagara Falls"}),
    "side": (urls.side_size_from_url, {
        "/7v7-night": 7, "/7vs7": 7, "/4on4": 4, "/6-v-6": 6, "/5V5": 5, "/5v6": None, "/none": None}),
    "level": (levels.comp_level, {
        " Competitive ": "A", "High Intermediate": "B+", "Beginner Rec": "C-", "rec/intermediate": "B+", "low novice": "D-",
        "upper": "A", "whatever": None, "": None, None: None, "advanced plus": "A+", "x / y": None}),
    "season": (codes.season_label, {"Late Winter": "Winter", "mid-Summer": "Summer", "Fall": "Fall", " early spring": "spring"}),
    "title": (text.title_case, {"co-ed night": "Co-Ed Night", "men's OPEN": "Men'S Open", "rec/inter 2b": "Rec/Inter 2B"}),
    "norm": (text.norm_text, {"  A   b\tC ": "a b\tc", None: ""}),
    "province": (levels.province, {"1 Main St, Ottawa, ON K1A 0A1, Canada": "ON", "Paris, France": None, None: None}),
    "address_city": (levels.city_of_address, {"1 Main St, Ottawa, ON K1A 0A1, Canada": "Ottawa", "Paris": None}),
    "rubric": (links.rubric_score, {"Register": 100, "Team rules": 50, "About": 25, "Contact us for fees": 0, "zzz": 0}),
    "main_text": (pages.html_to_main_text, {
        "<p>Hi there</p>\nHome\n<footer>x</footer>ok\nAll rights reserved 2020\nPlay &amp; win": "Hi there Play & win"}),
    "page_text": (pages.html_to_text, {"<script>x</script><b>A</b> <noscript>n</noscript>B&nbsp;C<!-- c -->": "A B C"}),
    "teams": (pages.has_team_list, {
        "<td>Red Hawks</td><li>Blue Jets</li><div>Iron Men</div>": True, "<td>Red Hawks</td><td>Red Hawks</td><td>ab</td>": False}),
}


@pytest.mark.parametrize("name", list(CASES))
def test_cases(spark, name):
    fn, table = CASES[name]
    assert values(spark, fn, list(table)) == list(table.values())


def test_build_code(spark):
    rows = spark.createDataFrame([("Summer", "soccer"), ("2", "01"), ("Nope", "Soccer"), ("Fall", "Track & Field")], "s string, p string")
    assert [r[0] for r in rows.select(codes.build_code(F.col("s"), F.col("p"))).collect()] == ["201", "201", None, "383"]
    codes_in = ["201", "2", "V10", "209", None, "999"]
    assert values(spark, codes.valid_code, codes_in) == [True, False, False, False, False, True]


def test_season_year_and_keys(spark):
    row = spark.createDataFrame([("2024-11-01", "2025-02-01", " NONE ", None, "")], "a string, b string, c string, d string, e string")
    got = row.select(keys.season_year(F.col("a"), F.col("b")), *[keys.known(text.norm_text(F.col(x))) for x in "cde"]).first()
    assert list(got) == [2025, None, None, None]


@pytest.mark.parametrize("url,title,snippet,reason", [
    ("https://a.com/x.pdf", "league", "", "invalid_file_type"),
    ("https://m.facebook.com/x", "league", "", "social_media"),
    ("https://yelp.com/biz", "league", "", "review_site"),
    ("https://maps.google.com/x", "", "", "social_media"),
    ("https://a.com/nhl", "", "", "professional_sports"),
    ("https://a.com/x", "U12 boys", "", "youth_organization"),
    ("https://a.com/x", "Club blog post", "", "not_league_content"),
    ("https://a.com/x", "Adult coed nights", "", "valid_adult_rec_league"),
    ("https://a.biz/x", "Join the league", "", "valid_league_page"),
    ("https://a.biz/x", "hello", "", "not_league_content"),
    ("", "league", "", "empty_url"),
])
def test_screening(spark, url, title, snippet, reason):
    df = spark.createDataFrame([(url, title, snippet)], "u string, t string, s string")
    content = screening.content_of(F.col("t"), F.col("s"))
    assert df.select(screening.validation_reason(F.col("u"), content)).first()[0] == reason


def test_word_patterns_agree_with_plain_search(spark):
    """The grouped pattern finds exactly the texts that hold one of the words."""
    words = ["u18", "rec", "record", ".ca", "$", "co-ed", "men's", "track & field"]
    texts = ["a u18 b", "the record", "x.cab", "xca", "5 $", "coed", "co-ed", "mens", "men's", "track and field", "track & field", ""]
    assert values(spark, lambda c: text.has_any(c, words), texts) == [any(w in t for w in words) for t in texts]

"""Similarity joins against the ratio of every pair, and how much the filters leave."""
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from clubsieve.operators import matching, similar
from clubsieve.plans import join_queries
from clubsieve.plans.registry import Inputs


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def texts(rng, n):
    words = ["north", "south", "park", "field", "arena", "éa", "x", "12", "  ", "aaaa", "ab", "日本", "🎉"]
    out = [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(n)]
    out += ["".join(rng.choices("ab c", k=rng.randrange(0, 7))) for _ in range(n)]
    near = [list(t) for t in out if t]
    for t in near[::2]:
        t[rng.randrange(len(t))] = rng.choice("abz")
    return out + ["".join(t) for t in near[::2]]


@pytest.mark.parametrize("floor", [0.4, 0.7, 0.8, 0.95])
def test_similar_pairs(spark, floor):
    rng = random.Random(floor)
    left, right = texts(rng, 40), texts(rng, 40)
    frame = lambda ts: spark.createDataFrame([(t,) for t in [*ts, *ts[:3], None]], "name string")
    got = {(r.a, r.b): r.ratio for r in similar.similar_pairs(frame(left), frame(right), floor).collect()}
    want = {(a, b): ratio(a, b) for a in set(left) for b in set(right) if ratio(a, b) >= floor}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_no_texts(spark):
    none = spark.createDataFrame([], "name string")
    assert similar.similar_pairs(none, none, 0.8).collect() == []


def test_filters_leave_little(spark):
    """Names that share nothing but common words: a tenth of all pairs at most is compared."""
    rng = random.Random(1)
    syllables = ["ka", "to", "mi", "ren", "sol", "var", "del", "gu", "ost", "fen", "lip", "qua"]
    names = ["".join(rng.choices(syllables, k=3)) + " " + "".join(rng.choices(syllables, k=3)) + " arena" for _ in range(300)]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    compared = similar.candidates(frame, frame, 0.8).count()
    assert compared <= len(set(names)) ** 2 / 10


def test_divisions_compare_few_pairs(spark):
    t = Inputs(spark, "/root/testdata/sf0.01")
    pairs = matching.division_pairs(join_queries.named_checks(t), t.listings.filter(~F.col("is_archived")))
    assert matching.compared(pairs, 0.4).count() <= pairs.count() / 10


def test_matched_divisions(spark):
    """Against the plain rule on random names: best ratio of at least 0.4, ties to the least id."""
    rng = random.Random(6)
    words = ["monday", "tuesday", "coed", "mens", "novice", "rec", "x"]
    pick = lambda: rng.choice([None, "", *words])
    listings = [(i, f"u{i % 7}", pick(), pick(), pick()) for i in range(90)]
    asked = [(i, f"u{i % 9}", rng.choice([None, "", " ".join(rng.choices(words, k=2)), "qq"])) for i in range(120)]
    got = {r.check_id: r.league_id for r in matching.match_divisions(
        spark.createDataFrame(asked, "check_id int, url string, division_name string"),
        spark.createDataFrame(listings, "league_id int, url_scraped string, day_of_week string, gender_eligibility string, source_comp_level string")).collect()}
    for i, url, name in asked:
        here = [(k, " ".join(p for p in parts if p).lower()) for k, u, *parts in listings if u == url]
        if not name:
            assert got[i] == (here[0][0] if len(here) == 1 else None)
            continue
        best = min(((-ratio(name.lower(), label), k) for k, label in here), default=(0, None))
        assert got[i] == (best[1] if -best[0] >= 0.4 else None)

"""Key matching and similarity joins against brute force, hot blocks included."""
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from clubsieve.functions import fixed_values as fv, keys, similarity
from clubsieve.operators import matching

SCHEMA = ("league_id bigint, base_domain string, url_scraped string, organization_name string, sport_name string, season_start_date date, season_end_date date, "
          "venue_name string, day_of_week string, source_comp_level string, gender_eligibility string, num_weeks int, players_per_side int")
NAMES = [p.split()[0] for p in SCHEMA.split(", ")]


def records(rng, n, first_id, hot=0.5):
    out = []
    for i in range(n):
        pick = lambda *xs: rng.choice(xs)
        domain = "hot.com" if rng.random() < hot else f"d{rng.randrange(5)}.com"
        out.append((first_id + i, domain, f"https://{domain}/{rng.randrange(3)}", pick("Org", "org ", None, "none"), pick("Soccer", "Tennis", None, ""), None, None,
                    pick("Park", "Hall", None), pick("Monday", "Friday", None), pick("Rec", "A", None), pick("CoEd", None), pick(8, 10, None), pick(5, None)))
    return out


def key_of(r):
    d = dict(zip(NAMES, r))
    out = []
    for f in fv.KEY_FIELDS:
        v = None if f == "season_year" else d[f]
        if isinstance(v, str):
            v = v.strip().lower()
            v = None if v in ("", "none") else v
        out.append(v)
    return out


def overlap(a, b):
    n = 0
    for x, y in zip(a, b):
        if x is not None and y is not None:
            if x != y:
                return -1
            n += 1
    return n


def test_best_matches_agree_with_all_pairs(spark):
    rng = random.Random(7)
    inc, old = records(rng, 150, 1000), records(rng, 200, 0)
    for least in (3, 1):
        want = {}
        for i in inc:
            options = [(overlap(key_of(i), key_of(o)), -o[0]) for o in old if o[1] == i[1]]
            best = max((x for x in options if x[0] >= least), default=None)
            if best:
                want[i[0]] = (-best[1], best[0])
        got = matching.best_matches(spark.createDataFrame(inc, SCHEMA), spark.createDataFrame(old, SCHEMA), min_overlap=least)
        assert {r.league_id: (r.match_id, r.overlap) for r in got.collect()} == want


def test_blocks_of_any_size_match_alike(spark):
    """Compared directly or looked up by shared values, mixed within one run too; odd texts and text ids included."""
    rng = random.Random(11)
    inc, old = records(rng, 60, 1000), records(rng, 90, 0)
    odd = [" Org\t", "ORG", "none ", "\u00a0org", "a  b", "a b\n", ""]
    inc, old = ([(*r[:3], rng.choice(odd), *r[4:]) for r in side] for side in (inc, old))
    kinds = SCHEMA, SCHEMA.replace("league_id bigint", "league_id string")
    named = lambda rows, kind: spark.createDataFrame(rows if kind == SCHEMA else [(f"x{r[0]:05d}", *r[1:]) for r in rows], kind)
    for kind in kinds:
        got = [{tuple(r) for r in matching.best_matches(named(inc, kind), named(old, kind), min_overlap=2, small=small).collect()}
               for small in ((0, 0), (20, 20), (64, 10000))]
        assert got[0] and got[0] == got[1] == got[2]


def test_small_blocks_move_each_record_once(spark):
    plan = matching.best_matches(*[spark.createDataFrame(records(random.Random(n), 10, n), SCHEMA) for n in (1, 100)])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortAggregate" not in plan


def test_key_texts_are_those_of_the_single_columns(spark):
    odd = [None, "", " ", "None", "none\n", " NONE\t", "a \u0085", "\u0085", "none \u0085", "A   b", "a \n\t b ", "\u00a0x", "\u0130 \u03a3"]
    df = spark.createDataFrame([(i, x, x, None, None, x, x, x, x, i, None) for i, x in enumerate(odd)], "league_id bigint, " + SCHEMA.split(", ", 3)[3])
    got = keys.known_keys(df, {f: f"k_{f}" for f in fv.KEY_FIELDS}, "league_id")
    want = df.select("league_id", *[keys.known(c) for c in keys.key_columns().values()])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    # One long generated method for all patterns would run interpreted.
    assert "transform(" in got._jdf.queryExecution().optimizedPlan().toString()


def test_hot_block_of_copies_stays_linear(spark):
    """20 000 copies on either side of one domain: pairs would be 400 million rows."""
    row = ("hot.com", "https://hot.com/", "Org", "Soccer", None, None, "Park", "Monday", None, "CoEd", 8, None)
    schema = SCHEMA.split(", ", 1)[1]
    copies = lambda start: spark.range(start, start + 20000).withColumnRenamed("id", "league_id").join(
        spark.createDataFrame([row], schema).withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).drop("one")
    got = matching.best_matches(copies(100000), copies(0))
    assert [tuple(r) for r in got.groupBy("match_id", "overlap").count().collect()] == [(0, 6, 20000)]


def test_no_all_pairs_join_in_plan(spark):
    df = spark.createDataFrame(records(random.Random(1), 10, 0), SCHEMA)
    plan = matching.best_matches(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_match_divisions_moves_the_named_records_once(spark):
    listings = spark.createDataFrame([(1, "u", "Monday", "CoEd", "Rec"), (2, "v", "Friday", None, None), (3, "u", None, None, None)],
                                     "league_id bigint, url_scraped string, day_of_week string, gender_eligibility string, source_comp_level string")
    rows = [(1, "u", "monday coed rec"), (2, "v", None), (3, "v", ""), (4, "u", ""), (5, None, None), (6, "v", "FRIDAY"), (7, "w", "")]
    out = matching.match_divisions(spark.createDataFrame(rows, "check_id int, url string, division_name string"), listings)
    assert {r.check_id: (r.league_id, r.ratio) for r in out.collect()} == {
        1: (1, 1.0), 2: (2, None), 3: (2, None), 4: (None, None), 5: (None, None), 6: (2, 1.0), 7: (None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1


def test_match_divisions_agrees_with_brute_force(spark):
    rng = random.Random(3)
    listings = [(i, f"u{rng.randrange(4)}", rng.choice(["Monday", "Friday", None]), rng.choice(["CoEd", "Mens", None]), rng.choice(["Rec", "Competitive", None]))
                for i in range(40)] + [(99, "alone", "Monday", None, None)]
    found = [(i, f"u{rng.randrange(4)}", rng.choice(["Monday Coed Rec", "fri mens", "competitive", "zzz", None, ""])) for i in range(60)] + [(98, "alone", None)]

    def label(x):
        return " ".join(p for p in x[2:] if p).lower()

    want = {}
    for i, url, name in found:
        here = [x for x in listings if x[1] == url]
        if not name:
            want[i] = here[0][0] if len(here) == 1 else None
            continue
        scored = [(SequenceMatcher(None, name.lower(), label(x)).ratio(), -x[0]) for x in here]
        best = max(scored, default=(0, 0))
        want[i] = -best[1] if best[0] >= 0.4 else None
    got = matching.match_divisions(spark.createDataFrame(found, "check_id bigint, url string, division_name string"), spark.createDataFrame(
        listings, "league_id bigint, url_scraped string, day_of_week string, gender_eligibility string, source_comp_level string"))
    assert {r.check_id: r.league_id for r in got.collect()} == want


def test_tab_score(spark):
    texts = ["View Standings", "standngs", "scedule", "qqq", "", "Fall 2024", None]

    def want(t):
        t = (t or "").lower().strip()
        return max([0.8 if w in t else r for w in fv.TAB_WORDS for r in [SequenceMatcher(None, t, w).ratio()] if w in t or r >= 0.5], default=0.0)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(similarity.tab_score("t")).collect()]
    assert [round(x, 9) for x in got] == [round(want(t), 9) for t in texts]


def test_venue_confidence(spark):
    rows = [("Central Park", "Ottawa", "central park", "1 St, OTTAWA, ON", ["park"], 5), ("Gym", None, "Gymnasium", "x", ["cafe"], 0),
            ("Gym", "Rome", None, None, None, None)]
    df = spark.createDataFrame(rows, "n string, c string, f string, a string, t array<string>, r int")
    got = [r[0] for r in df.select(similarity.venue_confidence(*[F.col(x) for x in "ncfatr"])).collect()]
    assert got == [100, round(SequenceMatcher(None, "gym", "gymnasium").ratio() * 40), 0]


def test_same_day_or_only(spark):
    old = spark.createDataFrame([(1, "a", "Monday"), (2, "b", "Monday"), (3, "b", None), (4, "b", None)], "league_id bigint, url_scraped string, day_of_week string")
    new = spark.createDataFrame([(10, "a", "Friday"), (11, "b", "monday"), (12, "b", ""), (13, "b", "Friday"), (14, "c", None)],
                                "league_id bigint, url_scraped string, day_of_week string")
    got = {r.league_id: r.existing_id for r in matching.same_day_or_only(new, old).collect()}
    assert got == {10: 1, 11: 2, 12: 3, 13: None, 14: None}


def test_text_ids(spark):
    """Latest rows, survivors, matches and merged groups take text ids; the least one wins a tie."""
    from clubsieve.operators import merge, ranking
    checks = spark.createDataFrame([("b", "l1", 5), ("a", "l1", 5), ("c", "l1", 4), ("d", None, 9)], "check_id string, league_id string, checked_at int")
    assert [r.check_id for r in ranking.latest_checks(checks).collect()] == ["a"]
    rows = spark.createDataFrame([("y", "k", 3, None, "p"), ("x", "k", 3, "v", None)], "league_id string, k string, quality_score int, a string, b string")
    assert [r.league_id for r in ranking.survivors(rows, "k").collect()] == ["x"]
    merged = merge.merge_groups(rows, ["k"]).first()
    assert (merged.league_id, merged.a, merged.b) == ("x", "v", "p")
    schema = ("league_id string, base_domain string, organization_name string, sport_name string, season_start_date date, season_end_date date, "
              "venue_name string, day_of_week string, source_comp_level string, gender_eligibility string, num_weeks int, players_per_side int")
    of = lambda i: (i, "a.com", "Org", "Soccer", None, None, "Gym", "Monday", None, None, 8, None)
    found = matching.best_matches(spark.createDataFrame([of("n")], schema), spark.createDataFrame([of("t"), of("s")], schema)).collect()
    assert [tuple(r) for r in found] == [("n", "s", 5)]

"""The sequential walks against plain Python, record by record."""
import random

import pytest
from pyspark.sql import Window, functions as F

from clubsieve.functions import fixed_values as fv
from clubsieve.operators import dedupe, ranking
from tests.test_matching import NAMES, SCHEMA, key_of, overlap, records

PAIR_SCHEMA = ("league_id bigint, url_scraped string, quality_score int, organization_name string, sport_season_code string, season_year int, "
               "venue_name string, day_of_week string, source_comp_level string")


def pair_rows(rng, n):
    pick = rng.choice
    return [(i, pick(["hot", "hot", "u1", "u2"]), pick([None, 10, 20, 20, 30]), pick(["Org", "ORG", None]), pick(["201", "301"]), pick([2024, 2025, None]),
             pick(["Park", "Hall", "", None]), pick(["Monday", "Friday", "Sunday"]), pick(["Rec", "A", "B", None])) for i in range(n)]


def lowered(r):
    return tuple(None if x is None else str(x).lower() for x in r[3:])


def greedy(rows):
    """The rule as stated: by quality, then id; each record takes its first later partner."""
    out = set()
    for url in {r[1] for r in rows}:
        here = sorted((r for r in rows if r[1] == url), key=lambda r: (-(r[2] or 0), r[0]))
        used = set()
        for n, a in enumerate(here):
            if n in used:
                continue
            for m in range(n + 1, len(here)):
                same = sum(x is None or y is None or x == y for x, y in zip(lowered(a), lowered(here[m])))
                if m not in used and same >= 4:
                    used.add(m)
                    out.add((url, a[0], here[m][0], same, "AUTO" if same >= 5 else "REVIEW"))
                    break
    return out


@pytest.mark.parametrize("big,rounds", [(dedupe.BIG_URL, 0), (1, 12), (60, 12), (1, 1), (1, 0)])
def test_pairs_agree_with_greedy_walk(spark, big, rounds):
    """In one task per URL, and in cliques and rounds in all or some URLs, however many rounds."""
    for seed in range(2):
        rows = pair_rows(random.Random(seed), 150)
        rows += [(1000 + i, "u2", 20, f"Club {i % 9}", "777", 1999, "Yard", "Noday", "Z") for i in range(40)]
        got = dedupe.duplicate_pairs(spark.createDataFrame(rows, PAIR_SCHEMA), big=big, rounds=rounds).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == greedy(rows)


def test_pairs_of_text_ids(spark):
    rows = [(f"k{r[0] * 7919 % 1000:03}", *r[1:]) for r in pair_rows(random.Random(7), 90)]
    text = PAIR_SCHEMA.replace("league_id bigint", "league_id string")
    for big in (dedupe.BIG_URL, 1):
        assert {tuple(r) for r in dedupe.duplicate_pairs(spark.createDataFrame([*rows, (None, *rows[0][1:])], text), big=big).collect()} == greedy(rows)
    assert dedupe.duplicate_pairs(spark.createDataFrame([], text)).collect() == []


def test_ranks_in_a_hot_group(spark):
    """One group with nine tenths of the rows is numbered over many ranges, as row_number() numbers it."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, (F.col("id") % 70).cast("string")).when(F.col("id") % 101 == 1, None).otherwise("hot").alias("g"),
                                    (F.col("id") * 7919 % 20_011).alias("v")).repartition(3)
    ranked = ranking.rank_in_groups(df, ["g"], [F.desc("v")], "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"))).cast("long"))
    assert ranked.exceptAll(want).count() == 0 and ranked.count() == want.count()
    assert ranking.rank_in_groups(df.limit(0), ["g"], ["v"]).collect() == []


def test_copies_are_spread_over_tasks(spark):
    """Copies of one key in one URL, a third of all rows: no task walks them."""
    walked = []
    plain = dedupe.walk_sorted
    dedupe.walk_sorted = lambda some, *rest: walked.append(some.count()) or plain(some, *rest)
    try:
        hot = spark.range(3000).selectExpr("id AS league_id", "'hot' AS url_scraped", "10 AS quality_score", "'Org' AS organization_name", "'201' AS sport_season_code", "2024 AS season_year",
                                           "concat('Park ', id % 3) AS venue_name", "concat('day ', id % 3) AS day_of_week", "concat('level ', id % 3) AS source_comp_level")
        assert dedupe.duplicate_pairs(hot, big=1000).count() == 1500 and walked == [0]
    finally:
        dedupe.walk_sorted = plain


def test_a_hot_url_of_many_keys_is_settled_in_rounds(spark):
    """Chains and cliques of keys beside copies in one URL: as in the walk, of which a twentieth at most is left."""
    pick = lambda n, salt: F.pmod(F.xxhash64("league_id", F.lit(salt)), F.lit(n)).cast("string")
    df = spark.range(6000).select(F.col("id").alias("league_id"), F.lit("hot").alias("url_scraped"), pick(50, 1).cast("int").alias("quality_score")).withColumns({
        "organization_name": pick(20, 2), "sport_season_code": pick(20, 3), "season_year": pick(5, 4).cast("int"), "venue_name": F.when(pick(99, 8) != "0", pick(20, 5)),
        "day_of_week": pick(7, 6), "source_comp_level": pick(20, 7)})
    seen = []
    plain = dedupe.walk_sorted
    want = dedupe.duplicate_pairs(df)
    dedupe.walk_sorted = lambda some, *rest: seen.append(some.count()) or plain(some, *rest)
    try:
        got = dedupe.duplicate_pairs(df, big=5000)
    finally:
        dedupe.walk_sorted = plain
    assert want.exceptAll(got).count() == 0 and got.count() == want.count() > 1000
    assert sum(seen) <= 300


def test_agreement_is_a_sum_of_weights():
    """Over all equal sets of two keys the weights sum to 1 where they agree on four fields, else to 0."""
    for shared in range(64):
        for equal in range(64):
            if equal & shared == equal:
                total = sum(w for s, w in dedupe.weighed_sets(shared) if s & equal == s)
                assert total == (6 - shared.bit_count() + equal.bit_count() >= 4)


def test_hot_url_of_copies_is_paired_without_gathering_it(spark):
    n = 50001
    row = F.struct(F.lit("hot").alias("url_scraped"), F.lit(10).alias("quality_score"), F.lit("Org").alias("organization_name"), F.lit("201").alias("sport_season_code"),
                   F.lit(2024).alias("season_year"), F.lit("Park").alias("venue_name"), F.lit("Monday").alias("day_of_week"), F.lit("Rec").alias("source_comp_level"))
    df = spark.range(n).select(F.col("id").alias("league_id"), row.alias("r")).select("league_id", "r.*")
    got = dedupe.duplicate_pairs(df).agg(F.count("*"), F.count_distinct("keep_id"), F.count_distinct("archive_id"), F.min("matched_fields")).first()
    assert tuple(got) == (n // 2, n // 2, n // 2, 6)


def walk_groups(rows, parent=None):
    """Batch deduplication as stated, one record at a time, copies of a key and page taken together."""
    parent = parent or {}
    page = lambda r: r[2]
    out = {}
    for block in {r[1] for r in rows}:
        here = sorted((r for r in rows if r[1] == block), key=lambda r: r[0])
        first = {}
        for r in here:
            first.setdefault((tuple(key_of(r)), page(r)), r[0])
        here.sort(key=lambda r: (first[tuple(key_of(r)), page(r)], r[0]))
        groups, opener = [], []
        for r in here:
            k = key_of(r)
            at = next((n for n, g in enumerate(groups) if overlap(k, g) >= 3), None)
            if at is None:
                for n, g in enumerate(groups):
                    o = opener[n]
                    linked = parent.get(page(r)) == page(o) or parent.get(page(o)) == page(r)
                    if linked and k[1] is not None and k[1] == key_of(o)[1] and overlap(k, g) >= 1:
                        at = n
                        break
            if at is None:
                groups.append(k)
                opener.append(r)
                at = len(groups) - 1
            else:
                groups[at] = [g if g is not None else x for g, x in zip(groups[at], k)]
            out[r[0]] = opener[at][0]
    return out


def test_groups_agree_with_record_walk(spark):
    for seed in range(3):
        rows = records(random.Random(seed), 120, 0)
        df = spark.createDataFrame(rows, SCHEMA)
        assert {r.league_id: r.group_id for r in dedupe.assign_groups(df).collect()} == walk_groups(rows)
        parents = {f"https://{d}/{i}": f"https://{d}/0" for d in ("hot.com", "d1.com", "d2.com") for i in (1, 2)}
        pm = spark.createDataFrame(list(parents.items()), "child_url string, parent_url string")
        assert {r.league_id: r.group_id for r in dedupe.assign_groups(df, parent_map=pm).collect()} == walk_groups(rows, parents)


def test_groups_of_text_ids(spark):
    rows = records(random.Random(9), 60, 0)
    named = lambda i: f"k{i:04}"
    df = spark.createDataFrame(rows, SCHEMA).withColumn("league_id", F.format_string("k%04d", "league_id"))
    assert {r.league_id: r.group_id for r in dedupe.assign_groups(df).collect()} == {named(a): named(b) for a, b in walk_groups(rows).items()}


def test_deduplicate_keeps_every_record_once(spark):
    rows = records(random.Random(5), 200, 0)
    out = dedupe.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.merged_records for r in out) == len(rows)
    assert len({r.group_id for r in out}) == len(out)


def test_merge_prefers_the_fullest_record(spark):
    rows = [(1, "d", "u", "Org", None, None, None, None, None, "Rec", None, None, None),
            (2, "d", "u", "Org", "Soccer", None, None, "Park", "Monday", None, None, 8, 5),
            (3, "d", "u", "Org", "Soccer", None, None, "Hall", None, "A", None, None, None)]
    out = dedupe.merge_groups(spark.createDataFrame(rows, SCHEMA), ["base_domain"]).first()
    assert (out.league_id, out.venue_name, out.source_comp_level, out.merged_records) == (2, "Park", "A", 3)
    assert out.identifying_fields_pct == round(100 * 7 / 9, 1)  # no year


def test_fields_used_exist():
    assert set(fv.KEY_FIELDS) - {"season_year"} <= set(NAMES)


def test_group_keys_are_normalised_once(spark, data):
    from clubsieve.plans.registry import Inputs
    plan = dedupe.assign_groups(Inputs(spark, data).listings_x)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "orders" not in plan


def test_few_open_records_are_tried_without_an_index():
    """The walk of a small URL builds no index, and any number of open records gives the same pairs."""
    rng = random.Random(5)
    rows = [{"league_id": i, **{f"f{k}": rng.choice([None, "a", "b", "c", "d"]) for k in range(6)}} for i in range(300)]

    def walked(few, some):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(dedupe, "FEW_OPEN", few)
            walk = dedupe.PairWalk(("u",))
            return [p for r in some for p in walk.step(r)], walk.index

    assert walked(-1, rows)[0] == walked(16, rows)[0] == walked(1000, rows)[0]
    pairs, index = walked(16, rows[:16])
    assert pairs and not index

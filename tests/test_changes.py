"""Invariants of the change plans, on the derived listings."""
import pytest
from pyspark.sql import functions as F

from clubsieve.operators import changes, filters, matching
from clubsieve.plans.registry import Inputs
from clubsieve.plans.scoring_queries import as_of


@pytest.fixture(scope="module")
def t(spark, data):
    return Inputs(spark, data)


def test_every_incoming_record_gets_one_action(t):
    plan = changes.insert_plan(t.incoming, t.stored)
    n = t.incoming.count()
    assert plan.count() == n and plan.select("league_id").distinct().count() == n
    assert {r.action for r in plan.select("action").distinct().collect()} <= {"INVALID", "MERGE", "INSERT", "REJECT_QUALITY"}
    after = changes.apply_insert_plan(t.incoming, t.stored, plan, as_of())
    inserted = plan.filter("action = 'INSERT'").count()
    assert after.count() == t.stored.count() + inserted == after.select("league_id").distinct().count()


def test_every_incoming_record_gets_one_decision(t):
    plan = changes.reconcile_plan(t.incoming, t.stored)
    assert plan.count() == t.incoming.count() == plan.select("league_id").distinct().count()
    assert plan.filter("decision = 'REVIEW' AND insert_action IS NOT NULL").count() == 0


def test_reconciled_table(t):
    """Nothing is lost, replaced records are archived, and no sure duplicate of a URL stays active."""
    plan = changes.reconcile_plan(t.incoming, t.stored).cache()
    after = changes.apply_reconcile(t.incoming, t.stored, plan, as_of()).cache()
    inserted = plan.filter("insert_action = 'INSERT'").count()
    assert after.count() == t.stored.count() + inserted == after.select("league_id").distinct().count()
    written_to = plan.filter("insert_action = 'MERGE'").select(F.col("match_id").alias("league_id"))
    replaced = plan.filter("decision = 'REPLACE'").select(F.col("existing_id").alias("league_id")).join(written_to, "league_id", "left_anti")
    assert replaced.count() > 0
    assert after.join(replaced, "league_id", "left_semi").filter("NOT is_archived").count() == 0
    before = t.stored.filter("is_archived").select("league_id").join(written_to, "league_id", "left_anti")
    assert after.join(before, "league_id", "left_semi").filter("NOT is_archived").count() == 0
    reviewed = plan.filter("decision = 'REVIEW'").select("league_id")
    assert after.join(reviewed, "league_id", "left_semi").count() == 0


def test_pages_tile_the_queue(t):
    total = t.queue.filter("status = 'PENDING'").count()
    seen, offset = [], 0
    while True:
        rows = filters.queue_page(t.queue, offset, 300, statuses=["PENDING"]).select("scrape_id").collect()
        if not rows:
            break
        seen += [r[0] for r in rows]
        offset += 300
    assert len(seen) == total == len(set(seen))


def test_merging_a_record_into_itself_changes_nothing(t):
    df = t.stored
    pairs = df.select("league_id", F.col("league_id").alias("match_id"))
    from clubsieve.operators.merge import merge_pairs
    merged = merge_pairs(df, df, pairs, as_of()).drop("merged_from", "quality_score")
    same = df.drop("quality_score").select(*merged.columns)
    assert merged.exceptAll(same).count() == 0 == same.exceptAll(merged).count()


def test_records_match_themselves(t):
    """A stored record looked up again finds a record with all of its fields."""
    found = matching.best_matches(t.stored, t.stored)
    filled = matching.keyed(t.stored, "base_domain").select("league_id", F.bit_count("mask").alias("n"))
    assert found.join(filled, "league_id").filter("overlap <> n").count() == 0


def test_updates_replace_with_nulls_too(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    up = spark.createDataFrame([(2, None)], "k int, x string")
    assert sorted(tuple(r) for r in changes.apply_updates(df, up, "k").collect()) == [(1, "a", 1), (2, None, 2)]


def test_venue_place_ids_are_never_stolen(t, spark):
    venues = spark.createDataFrame([(1, "Park", "p1"), (2, "Hall", "p2"), (3, "Gym", None)], "venue_id bigint, venue_name string, google_place_id string")
    new = spark.createDataFrame([(1, "PARK", "p2", None), (2, "Other", "p2", None), (3, "gym", "p9", None), (4, "New", "p7", None)],
                                "seq int, venue_name string, google_place_id string, address string")
    plan = {r.seq: (r.venue_id, r.action, r.new_place_id) for r in changes.venue_upsert_plan(venues, new).collect()}
    assert plan == {1: (1, "UPDATE_BY_NAME", None), 2: (2, "UPDATE_BY_PLACE", "p2"), 3: (3, "UPDATE_BY_NAME", "p9"), 4: (None, "INSERT", "p7")}
    after = changes.apply_venue_upsert(venues, changes.venue_upsert_plan(venues, new)).collect()
    assert sorted((r.venue_name, r.google_place_id) for r in after) == [("New", "p7"), ("Other", "p2"), ("PARK", "p1"), ("gym", "p9")]


def test_venue_names_and_places_stay_unique(spark):
    """One name with several places, one place under several names, and a name that reads like an id."""
    venues = spark.createDataFrame([(1, "Park", "p1"), (12, "Hall", None)], "venue_id bigint, venue_name string, google_place_id string")
    new = spark.createDataFrame(
        [(1, "Rink", "p5", None), (2, "RINK", "p6", None), (3, "Arena", "p7", None), (4, "Arena West", "p7", None), (5, "12", None, None),
         (6, "hall", "p8", None), (7, "Dome", "p8", "1 Elm St, Delta, AB T1T 1T1, Canada")],
        "seq int, venue_name string, google_place_id string, address string").withColumn("lng", F.col("seq").cast("double"))
    after = changes.apply_venue_upsert(venues, changes.venue_upsert_plan(venues, new)).collect()
    got = {r.venue_name: (r.venue_id, r.google_place_id, r.lng, r.city) for r in after}
    assert len(after) == len({r.venue_name.lower() for r in after})
    assert got == {"Park": (1, "p1", None, None), "RINK": (None, "p6", 2.0, None), "Arena West": (None, "p7", 4.0, None), "12": (None, None, 5.0, None),
                   "hall": (12, "p8", 6.0, None), "Dome": (None, None, 7.0, "Delta")}


def test_every_merged_record_gives_its_values(spark):
    """Three records merge into one: each value comes from the best-scored record that has one."""
    schema = "league_id string, created_at string, quality_score int, url_scraped string, a string, b string, c string, d string"
    stored = spark.createDataFrame([("s", "old", 40, "u", "sa", None, "sc", None), ("t", "old", 1, "u", "ta", None, None, None)], schema)
    new = spark.createDataFrame([("x", "new", 50, "u", None, "xb", None, None), ("y", "new", 40, "u", "ya", "yb", None, None),
                                 ("z", "new", 10, "u", "za", "zb", "zc", "zd")], schema)
    pairs = new.select("league_id", F.lit("s").alias("match_id"))
    from clubsieve.operators.merge import merge_into
    from clubsieve.functions import scoring
    with pytest.MonkeyPatch.context() as m:
        m.setattr(scoring, "quality_score", lambda df, as_of: F.lit(99))
        got = sorted(tuple(r) for r in merge_into(new, stored, pairs, as_of()).collect())
    assert got == [("s", "old", 99, "u", "ya", "xb", "sc", "zd", True), ("t", "old", 1, "u", "ta", None, None, None, False)]


def test_reviews_keep_the_whole_record(t):
    plan = changes.reconcile_plan(t.incoming, t.stored)
    rows = changes.review_rows(t.incoming, plan).collect()
    assert len(rows) == plan.filter("decision = 'REVIEW'").count() > 0
    assert all(r.reason and r.existing_league_id and "organization_name" in r.extracted for r in rows)

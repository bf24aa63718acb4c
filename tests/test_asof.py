"""The as-of join against DuckDB's own and against plain Python."""
import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from clubsieve.operators import asof

START = datetime.datetime(2024, 1, 1)


def frames(spark, asked, states):
    return (spark.createDataFrame(asked, "ask_id int, key string, at timestamp, state string"),
            spark.createDataFrame(states, "state_id int, key string, since timestamp, ask_id string"))


def moment(rng):
    return START + datetime.timedelta(minutes=30 * rng.randrange(0, 1500))


@pytest.mark.parametrize("within, slot", [(None, 1.0), (7, 1.0), (2, 0.25), (7, 40.0)])
def test_against_plain_rule(spark, within, slot):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    asked = [(i, key(), moment(rng) if i % 15 else None, "x") for i in range(200)]
    asked += asked[:5]
    states = [(i, key() if i % 3 else "b", moment(rng) if i % 17 else None, "y") for i in range(150)]
    states += [(1000 + i, k, t, n) for i, k, t, n in states[:40]]
    a, s = frames(spark, asked, states)
    got = asof.latest_before(a, s, ["key"], "at", "since", "state_id", within, slot, "found")
    assert got.columns == [*a.columns, "found"] and asof.latest_before(a, s, ["key"], "at", "since", "state_id").columns == a.columns

    def plain(k, t):
        fits = [r for r in states if k is not None and t is not None and r[1] == k and r[2] is not None and r[2] <= t and (within is None or r[2] >= t - datetime.timedelta(days=within))]
        return min(fits, key=lambda r: (-(r[2] - START).total_seconds(), r[0]))[0] if fits else None

    assert sorted((r.ask_id, r.found and r.found.state_id) for r in got.collect()) == sorted((i, plain(k, t)) for i, k, t, _ in asked)


def test_against_duckdb(spark):
    rng = random.Random(5)
    asked = [(i, rng.choice("abc"), moment(rng), None) for i in range(300)]
    states = [(i, rng.choice("abcd"), moment(rng), None) for i in range(300)]
    a, s = frames(spark, asked, states)
    con = duckdb.connect()
    con.register("asked", a.select("ask_id", "key", "at").toPandas())
    con.register("states", s.select("state_id", "key", "since").toPandas())
    want = con.execute("""
        WITH one AS (SELECT key, since, min(state_id) AS state_id FROM states GROUP BY ALL)
        SELECT ask_id, state_id FROM asked ASOF LEFT JOIN one ON asked.key = one.key AND asked.at >= one.since""").fetchall()
    got = asof.latest_before(a, s, ["key"], "at", "since", "state_id").select("ask_id", "state.state_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_rows(spark):
    a, s = frames(spark, [(1, "k", START, None)], [])
    assert [r.state for r in asof.latest_before(a, s, ["key"], "at", "since", "state_id").collect()] == [None]
    assert asof.latest_before(a.limit(0), s, ["key"], "at", "since", "state_id").collect() == []


def test_a_hot_key_is_spread_over_slots(spark):
    """No window is by the key alone but the one over slots: a hot key is cut by time before its rows are walked."""
    n = 50_000
    asked = spark.range(n).select(F.col("id").cast("int").alias("ask_id"), F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.lit("x").alias("state"))
    states = spark.range(n // 10).select(F.col("id").cast("int").alias("state_id"), F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 600).alias("since"))
    got = asof.latest_before(asked, states, ["key"], "at", "since", "state_id", 7)
    assert got.where("state.state_id is distinct from cast(floor(ask_id / 10) as int)").count() == 0 and got.count() == n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("Window [last") == 2

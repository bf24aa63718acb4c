"""SimHash, its links and components on small and awkward tables."""
import random
from collections import Counter

from pyspark.sql import functions as F

from . import brute
from clubsieve.llm import simhash
from clubsieve.llm.components import components


def classes(spark, fps, parts):
    df = spark.createDataFrame([(simhash._signed(f),) for f in set(fps)], "fp bigint")
    rows = components(simhash.links(df, 4, parts), "a", "b").collect()
    return {r.node % (1 << 64): r.component % (1 << 64) for r in rows}


def plain(fps):
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def same_classes(got, want):
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    every = {**{f: f for f in want}, **got}
    assert groups(every) == groups(want)


def test_both_forms_find_every_link(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(10):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4, 5))))
    want = plain(sorted(fps))
    for parts in (1, 3):
        same_classes(classes(spark, fps, parts), want)


def test_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "y"), (4, "One two", "y"), (5, "one TWO", "z"), (5, "one TWO", "z"), (6, long, "z"), (7, long + " tail", "z"), (8, "a b c d", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = Counter(map(tuple, simhash.near_copies(docs).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component").collect()))
    assert got == brute.near_copies([(i, t) for i, t, _ in rows])
    assert simhash.near_copies(docs.limit(0)).collect() == []

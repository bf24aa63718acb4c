"""The codes must decide: few pairs are measured, and nearly all true neighbours are among them."""
import numpy as np
from pyspark.sql import functions as F

from . import brute
from clubsieve.llm import ann, queries

def asked():
    return F.col("id") % 50 == 0


def test_codes_exclude_nine_tenths_of_all_pairs(spark):
    table = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = ann.usable(table, "vec_id", "embedding").dropDuplicates().withColumns({"tag": F.xxhash64("v"), "dim": F.size("v")}).cache()
    n, q = rows.count(), rows.where(asked()).count()
    pairs = ann.candidates(rows, rows.where(asked()), n, q, 5).count()
    assert pairs <= 0.1 * n * q
    want = {(i, j) for i, found in brute.nearest([(r.vec_id, r.embedding) for r in table.collect()]).items() for j, _ in found}
    got = {(r.query_id, r.vec_id) for r in ann.nearest(table, asked()).collect()}
    assert len(want) == len(got) and len(want & got) >= 0.97 * len(want)


def test_bounds_hold_for_short_and_long_vectors():
    rng = np.random.default_rng(4)
    for dim in (3, 64, 100, 1500):
        turn = ann.rotation(dim)
        assert np.allclose(turn @ turn.T, np.eye(dim))
        v, q = rng.standard_normal((2000, dim)), rng.standard_normal((5, dim))
        bits, scalar = ann.codes(v, turn)
        for one, planes, low, step in zip(q, *ann.query_codes(q, turn)):
            guess, error = ann.estimate(bits.T.copy(), scalar, planes, low, step)
            true = v @ one / np.linalg.norm(v, axis=1) / np.linalg.norm(one)
            assert (np.abs(true - guess) <= error).mean() > 0.98 and error.max() < 0.12


def test_lengths_do_not_meet_and_repeated_rows_count_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8 if i % 3 else 5).tolist()) for i in range(200)]
    rows += [(7, rng.standard_normal(8).tolist()), (50, rng.standard_normal(8).tolist())] + rows[:20]
    rows += [(1000, [1.0, 2.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), asked()).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    distinct = {(i, tuple(np.float32(v).astype(float))) for i, v in rows}
    want = {}
    for i, q in distinct:
        if i % 50 == 0:
            cos = lambda v: float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v))
            want.setdefault(i, []).extend((-cos(v), j) for j, v in distinct if j != i and len(v) == len(q))
    want = {i: sorted(found)[:5] for i, found in want.items() if found}
    assert set(got) == set(want) and 1000 not in got
    for i, found in want.items():
        assert [j for j, _ in got[i]] == [j for _, j in found] and np.allclose([s for _, s in got[i]], [-s for s, _ in found])

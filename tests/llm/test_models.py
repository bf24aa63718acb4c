"""Classifiers: held-out accuracy and awkward tables."""
import random

import numpy as np

from clubsieve.llm import linear, quality, queries, toxicity

PLAN = linear.Plan(labels=("insult", "contempt", "toxic"), grams=(5, 6), rows=400, features=256, steps=60)


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["tree", "river", "über", "stone", "été", "walks", "sings", "over"]
    rows = []
    for i in range(n):
        bad = rng.choice([(), (), ("idiot",), ("pathetic",), ("idiot", "pathetic"), ("vorgax" + rng.choice(plain),)])
        words = [rng.choice(plain) for _ in range(rng.choice((20, 60, 400)))]
        for b in bad:
            words.insert(rng.randrange(len(words)), b)
        rows.append((i, " ".join(words), int("idiot" in bad), int("pathetic" in bad), int(bool(bad))))
    return rows


def test_chain_on_held_out_rows(spark):
    rows = corpus(1200, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows if r[0] % 3], "doc_id bigint, insult int, contempt int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, plan=PLAN).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([got[r[0]].is_toxic == bool(r[4]) for r in held]) > 0.97
    assert np.mean([(got[r[0]].p_insult > 0.5) == bool(r[2]) for r in held]) > 0.97


def test_out_of_fold_probabilities_are_calibrated():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 5)).astype(np.float32)
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    w, bias, a, b = next(iter(linear.fit_chain(x, y[:, None], linear.Plan(labels=("l",)))))
    guess = linear.probability(x @ w.astype(np.float32) + bias, a, b)
    assert np.abs(guess - p).mean() < 0.05


def test_awkward_rows(spark):
    rows = [(1, None, "p"), (2, "", "p"), (3, "word " * 50_000, "q"), (3, "word " * 50_000, "q"), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p_toxic string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int, insult int, contempt int")
    one = spark.createDataFrame([(3, 1, 1, 1, 1), (None, 0, 0, 0, 0), (1, None, None, None, None)], none.schema)
    for labels in (none, one):
        got = toxicity.score_toxicity(docs, labels, plan=PLAN).collect()
        assert len(got) == 5 and all(r.p_toxic is None and r.is_toxic is False for r in got)
        kept = quality.score_quality(docs, labels).collect()
        assert [r.kept for r in sorted(kept, key=lambda r: (r.id or 0))] == [False] * 5 and all(r.p_quality is None for r in kept)
    both = spark.createDataFrame([(1, 1, 0, 0, 0), (3, 0, 1, 1, 1)], none.schema)
    assert all(r.p_toxic is not None for r in toxicity.score_toxicity(docs, both, plan=PLAN).collect())
    assert quality.score_quality(docs.limit(0), both).collect() == []
    assert toxicity.score_toxicity(docs.limit(0), toxicity.weak_labels(docs.limit(0), both)).collect() == []


def test_rare_toxic_words_of_held_out_labels(spark, tmp_path):
    # 149 words of eight letters have 1788 hashed features of their own.
    rng = random.Random(4)
    rare = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(149)]
    rows = []
    for i in range(4000):
        words = [rng.choice(("tree", "river", "stone", "walks")) for _ in range(20)]
        if i % 2:
            words.insert(rng.randrange(len(words)), rare[i // 2 % len(rare)])
        rows.append((i, " ".join(words), i % 2))
    spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, toxic) for i, _, toxic in rows if i % 3], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.toxic for r in queries.op4_toxicity(spark, str(tmp_path)).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([got[i] for i, _, toxic in held if toxic]) > 0.97
    assert not any(got[i] for i, _, toxic in held if not toxic)


def test_the_models_read_ten_thousand_labelled_rows():
    for plan in (toxicity.PLAN, quality.PLAN):
        assert (plan.rows, plan.features) == (10_000, 2048)

"""Chunk reuse must never change an id."""
import random

import pytest

from . import brute
from clubsieve.llm import bpe

NAME = "byte_bpe_50k.json"


def check(spark, texts, most=bpe.MOST_CHUNKS):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r for r in bpe.decode(bpe.encode(docs, most_chunks=most)).collect()}
    for i, t in rows:
        ids = brute.ids(NAME, t)
        assert memoryview(bytes(got[i].ids)).cast("H").tolist() == ids
        assert got[i].text == brute.tokenizer(NAME).decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("most", [0, 3, 8192])
def test_shared_passages(spark, most):
    rng = random.Random(5)
    words = ["alpha", "été", "x1", "don't", "\n", "  ", "日本", "end.", "(b)", "\t", "!!", "über", "<|", "12.5"]
    passages = [" ".join(rng.choice(words) for _ in range(900)) for _ in range(4)]
    texts = [None, "", " ", "short"]
    for k in range(24):
        texts.append("".join(rng.choice([p, p[rng.randrange(500):], f"{k} own words ", "\n", " ", "<|endoftext|>" if k % 7 == 0 else "y"]) for p in rng.sample(passages, 3)))
    check(spark, texts + texts[:6], most)


def test_one_text_of_many_chunks(spark):
    check(spark, ["ab " * 70_000, "a" * 30_000, "é " * 9_000, ("line of text\n" * 4_000)])


def test_no_rows(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string, ids string")).collect() == []

"""Token counts against the libraries, and the proof of the shortcut."""
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from . import brute
from clubsieve.llm import token_counts

PARTS = ["the", " ", "  ", "\n", "don't", "'S", "ÉTÉ", "é", "İ", "ΣΑΣ", "日本", "½", "①", "12", "x_y", "<|endoftext|>", "<|startoftext|>", "<|END", "🎉", " ", " ", "​", "﻿", "ß", "▁", "\0", "!!", "ǅ", " ́", "the,of"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_query(run, documents):
    want = sorted((i, len((t or "").encode()), n := len(brute.ids("word_bpe_49k.json", t)), n > 2048) for i, t in documents)
    assert sorted(map(tuple, run("op12_token_counts"))) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_awkward_texts(spark, name):
    rng = random.Random(8)
    texts = [None, "", " ", "a ", "same", "same", "w " * 60_000] + ["".join(rng.choices(PARTS, k=rng.randrange(1, 25))) for _ in range(400)]
    frame = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    count = library(name)
    got = token_counts.count_tokens(frame, tokenizer=public_tokenizers.path(name), limit=9, most=50).collect()
    want = [(i if i != 3 else None, len((t or "").encode()), n := count(t or ""), n > 9) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(frame.limit(0)).collect() == []


def test_proof():
    """Every proven string is one token alone; what is left out is not, or is no pre-token."""
    path = public_tokenizers.path("word_bpe_49k.json")
    proven = set(token_counts.prove(path))
    tokenizer = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in enumerate(token_counts.byte_characters())}
    for shown in proven:
        assert len(tokenizer.encode(bytes(byte_of[c] for c in shown).decode(), add_special_tokens=False).ids) == 1
    assert len(proven) > 30_000 and "the" in proven and "xqzzq" not in proven


def test_the_shortcut_carries_most_words(documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = token_counts.counter(path, token_counts.prove(path), 1_000_000)
    tokens = [t for _, text in documents[:50] for t in counter.enc.split.findall((text or "").lower())]
    assert sum(t in counter.whole for t in tokens) > len(tokens) / 3

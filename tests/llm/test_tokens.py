"""The piece encoder against the library."""
import random

import pytest
from hypothesis import given, settings, strategies as st

from . import brute
from clubsieve.llm.tokens import default_path, encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "a \n b\n\n c", "a\n b", "don't  we'll it's", "<|endoftext|> x <|startoftext|>", "x<|endoftext|>", "é É ǅ Σ ΟΔΟΣ. ß", " x ᠎y ​z ﻿w \x1cq \x85r",
       "tab\t tab \tx", "ab1234 12.5 #*$%&|<>!", "日本語 テキスト 한국어", "é a ́b", "🙂🙂 👩‍👩‍👧 x", "a\r\nb \r\n c", "  ", "\n", " \n", "\n\n\n x", "a' s 's", "x" * 5000]


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    enc = encoder(default_path(name))
    for t in ODD:
        assert enc.ids(t).tolist() == brute.ids(name, t), repr(t)


@pytest.mark.parametrize("name", FILES)
def test_mixed_pieces(name):
    enc, rng = encoder(default_path(name)), random.Random(1)
    parts = ["word", "Ünder", "été", ".", ",", "!!", "12", "7", " ", "  ", "\n", "\n\n", "\t", "'s", "-", "|", "<", "日", " ", "ﬁ", "İ", "(x)"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert enc.ids(t).tolist() == brute.ids(name, t), repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    for name in FILES:
        assert encoder(default_path(name)).ids(text).tolist() == brute.ids(name, text)


def test_full_memory_changes_nothing():
    from clubsieve.llm.tokens import PieceEncoder
    enc = PieceEncoder(default_path(FILES[0]), most=2)
    for t in ("one two three. four", "five six, two one"):
        assert enc.ids(t).tolist() == brute.ids(FILES[0], t)

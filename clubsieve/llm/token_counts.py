"""Token counts without ids: vocabulary strings that are proven to be one token are counted, only the rest is merged.

1. Offline, once per job: every string of the vocabulary is encoded alone by the library. Those that give
   exactly one id and one pre-token are proven; the list, never longer than the vocabulary, goes to all tasks.
2. A text is split into the library's pre-tokens. Merges never cross them, so each adds its own count: one if
   it is proven, else the number of tokens the library's model merges it into.

Pre-tokens of plain texts come from a pattern that is checked against the library; those of other stretches
come from the library's own normalizer and pre-tokenizer.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .tokens import _CUT, _SIMPLE, PieceEncoder, byte_characters, default_path


def prove(path: str) -> list[str]:
    """The strings that the library encodes alone as one token, as they stand in a pre-token: of a sentencepiece
    model with its leading spaces, of a tokenizer file byte by byte in the characters of its vocabulary."""
    if path.endswith(".model"):
        model = _model(path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        strings = [p.replace("▁", " ") for p in pieces if re.fullmatch("▁+[^▁]+", p)]
        return [s for s, ids in zip(strings, model.encode([s[1:] for s in strings])) if len(ids) == 1]
    enc = PieceEncoder(path, 0)
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    out = []
    for piece in enc.tokenizer.get_vocab(with_added_tokens=False):
        shown = piece.removesuffix(enc.model.end_of_word_suffix or "")
        try:
            text = bytes(byte_of[c] for c in shown).decode()
        except (KeyError, UnicodeDecodeError):  # half a character, or no byte string: never a pre-token by itself
            continue
        if text and _shown_tokens(enc, text) == [shown] and len(enc.tokenizer.encode(text, add_special_tokens=False).ids) == 1:
            out.append(shown)
    return out


def _model(path: str):
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=path)


def _shown_tokens(enc: PieceEncoder, text: str) -> list[str]:
    """The library's own pre-tokens of a text without added tokens."""
    tokenizer = enc.tokenizer
    normal = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
    return [t for t, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


class JsonCounter:
    """count(text) for a tokenizer file; `proven` comes from prove(). At most `most` merged counts are remembered."""

    def __init__(self, path: str, proven: list[str], most: int):
        enc = self.enc = PieceEncoder(path, 0)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.shown = frozenset(proven)
        self.whole = frozenset(bytes(byte_of[c] for c in s).decode() for s in proven)
        self.merged: dict[str, int] = {}
        self.most = most
        self.added = re.compile("|".join(map(re.escape, enc.added))) if enc.added else None
        self.splits = enc.space_leads or enc.drops_space

    def _merge(self, token: str) -> int:
        n = self.merged.get(token)
        if n is None:
            n = len(self.enc.model.tokenize(token.encode().decode("latin-1").translate(self.enc.shown)))
            if len(self.merged) < self.most:
                self.merged[token] = n
        return n

    def _plain(self, text: str) -> int:
        tokens = self.enc.split.findall(text.lower() if self.enc.drops_space else text)
        rest = [t for t in tokens if t not in self.whole]
        return len(tokens) - len(rest) + sum(map(self._merge, rest))

    def _odd(self, text: str) -> int:
        tokens = _shown_tokens(self.enc, text)
        return sum(1 if t in self.shown else len(self.enc.model.tokenize(t)) for t in tokens)

    def count(self, text: str) -> int:
        if not self.splits:
            return len(self.enc.whole(text)) // self.enc.dtype.itemsize
        if self.added and self.added.search(text):
            stretches = self.added.split(text)
            return len(stretches) - 1 + sum(map(self._stretch, stretches))
        return self._stretch(text)

    def _stretch(self, text: str) -> int:
        if _SIMPLE.fullmatch(text):
            return self._plain(text)
        pieces = text.split(" ") if self.enc.drops_space else _CUT.split(text)
        return sum(self._plain(p) if _SIMPLE.fullmatch(p) else self._odd(p) for p in pieces)


class PieceCounter:
    """count(text) for a sentencepiece model. Pre-tokens are spaces with what follows them, which no piece may cross;
    texts that the model normalizes, and models with such pieces, are encoded whole."""

    def __init__(self, path: str, proven: list[str], most: int):
        self.model, self.whole, self.merged, self.most = _model(path), frozenset(proven), {}, most
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces) and self.model.piece_to_id("▁") != self.model.unk_id()

    def _merge(self, token: str) -> int:
        n = self.merged.get(token)
        if n is None:
            n = len(self.model.encode(token[1:])) if token != " " else 1
            if len(self.merged) < self.most:
                self.merged[token] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits or "▁" in text or self.model.normalize(text) != "▁" + text.replace(" ", "▁"):
            return len(self.model.encode(text))
        tokens = re.findall(" *[^ ]+| +", " " + text)
        rest = [t for t in tokens if t not in self.whole]
        return len(tokens) - len(rest) + sum(map(self._merge, rest))


_counters: dict[tuple, JsonCounter | PieceCounter] = {}


def counter(path: str, proven: list[str], most: int = 300_000):
    """One counter for each file and process."""
    if (path, most) not in _counters:
        _counters[path, most] = (PieceCounter if path.endswith(".model") else JsonCounter)(path, proven, most)
    return _counters[path, most]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 2048, most: int = 300_000) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row, as its library counts it.

    No begin, end or added special tokens; strings of special tokens inside texts are what the library makes of
    them by default. A null text is empty and has none. Very long texts are counted whole, repeated rows each,
    null ids stay, an empty table gives no rows. Other columns take no part. There is no shuffle.
    """
    tokenizer = tokenizer or default_path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    proven = docs.sparkSession.sparkContext.broadcast(prove(tokenizer))

    def run(batches):
        count = counter(tokenizer, proven.value, most).count
        for b in batches:
            texts = W.text_bytes(b.column(1))
            n = np.fromiter((count(t.decode()) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")

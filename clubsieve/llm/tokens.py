"""Encoding of whole texts with a tokenizer file, remembering the pieces between spaces.

Both kinds of vocabulary used here split a text before they merge, and never across a space, so a text's
ids are those of its pieces one after the other. Which spaces may be cut depends on the kind:

* byte level with the usual pattern: a space goes with the word after it, and a run of white space is
  split by what follows, so a text is cut only before a space that a visible character follows;
* word pattern that drops white space: a text is cut at any space.

Other kinds, and texts that hold an added token, are encoded whole by the library.
"""
from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_ODD = "\u180e\u200b\ufeff"  # white space in some tables only
_CUT = re.compile(rf"(?= [^\s{_ODD}])")


def default_path(name: str) -> str:
    """Where the public vocabulary of that name lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


_LETTER, _MARK, _BLANK = "A-Za-zÀ-ÖØ-öø-ÿ", r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~""", r" \t\n\v\f\r"
#: Texts of these characters alone; in them, each character's class and so every pre-token is beyond doubt.
_SIMPLE = re.compile(rf"[{_LETTER}0-9{_MARK}{_BLANK}]*")
_CONTRACTED = "'(?:[stmd]|re|ve|ll)"
#: Pre-tokens of such texts, by whether a space goes with the word after it.
_TOKENS = {True: re.compile(rf"{_CONTRACTED}| ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"),
           False: re.compile(rf"{_CONTRACTED}|[{_LETTER}]+|[0-9]|[{_MARK}]+")}


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class PieceEncoder:
    """encode(text) gives the ids that the library gives without special tokens, as little-endian integers.

    Pre-tokens, and pieces of less simple texts, are remembered until there are `most` of them. Those seen
    first stay, as these are mostly the frequent ones.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.space_leads = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre.get("add_prefix_space")
        steps, norms = pre.get("pretokenizers", []), [n["type"] for n in (norm or {}).get("normalizers", [])]
        self.drops_space = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] \
            and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and norms == ["NFC", "Replace", "Lowercase"]
        self.split = _TOKENS[self.space_leads]
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        self.most = most
        self.plain: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _token(self, token: str) -> bytes:
        """The ids of one pre-token, from the library's model."""
        ids = array(self.code, [t.id for t in self.model.tokenize(token.encode().decode("latin-1").translate(self.shown))]).tobytes()
        if len(self.tokens) < self.most:
            self.tokens[token] = ids
        return ids

    def _simple(self, text: str) -> bytes:
        tokens = self.split.findall(text.lower() if self.drops_space else text)
        found = list(map(self.tokens.get, tokens))
        if None in found:
            new = self._token
            found = [ids if ids is not None else self.tokens.get(t) or new(t) for t, ids in zip(tokens, found)]
        return b"".join(found)

    def _piece(self, piece: str) -> bytes:
        ids = self.plain.get(piece)
        if ids is None:
            ids = self._simple(piece) if _SIMPLE.fullmatch(piece) else self.whole(piece)
            if len(self.plain) < self.most:
                self.plain[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not (self.space_leads or self.drops_space) or any(a in text for a in self.added):
            return self.whole(text)
        if _SIMPLE.fullmatch(text):
            return self._simple(text)
        return b"".join(map(self._piece, text.split(" ") if self.drops_space else _CUT.split(text)))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, most: int = 600_000) -> PieceEncoder:
    """One encoder for each file and process."""
    if (path, most) not in _encoders:
        _encoders[path, most] = PieceEncoder(path, most)
    return _encoders[path, most]

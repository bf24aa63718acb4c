"""Plain versions of the operators, one text after the other, to compare with."""
from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies(rows, radius=4):
    """doc_id -> (fingerprint, component) for rows of (doc_id, text)."""
    fps = [(i, fingerprint(t)) for i, t in rows]
    parent = {f: f for _, f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    every = sorted(parent)
    for k, a in enumerate(every):
        for b in every[k + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for i, f in fps:
        least[root(f)] = min(i, least.get(root(f), i))
    return Counter((i, f"{f:016x}", least[root(f)]) for i, f in fps)


def substrings(rows, width=35):
    seqs = [(i, words(t)) for i, t in rows]
    count = Counter(tuple(w[k:k + width]) for _, w in seqs for k in range(len(w) - width + 1))
    out = Counter()
    for i, w in seqs:
        gone = {k + d for k in range(len(w) - width + 1) if count[tuple(w[k:k + width])] > 1 for d in range(width)}
        out[i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


_loaded = {}


def tokenizer(name):
    if name not in _loaded:
        _loaded[name] = Tokenizer.from_file(public_tokenizers.path(name))
        _loaded[name].no_truncation()
        _loaded[name].no_padding()
    return _loaded[name]


def ids(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


def crc(tokens):
    return zlib.crc32(struct.pack(f"<{len(tokens)}I", *tokens))


def nearest(rows, k=5, every=50):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            score = sorted((-float((q * v).sum() / np.sqrt((q * q).sum()) / np.sqrt((v * v).sum())), j) for j, v in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in score]
    return out


ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(found)]

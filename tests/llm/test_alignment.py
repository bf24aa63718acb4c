"""Alignment of two tokenizers against a plain version over sets of byte offsets."""
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from . import brute
from clubsieve.llm import align
from clubsieve.llm.bpe import byte_table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENS_A = byte_table(A)


def plain(rows):
    """Rows as the query returns them, from whole texts and the libraries."""
    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    docs, count = [], Counter()
    for i, text in rows:
        links, groups = [], []
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(TOKENS_A[x] for x in a) != want or b"".join(map(piece, b)) != want:
            a, b = [], []
        spans_a, spans_b, at = [], [], 0
        for x in a:
            spans_a.append((at, at := at + len(TOKENS_A[x])))
        at = 0
        for x in b:
            spans_b.append((at, at := at + len(piece(x))))
        shared = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        for begin, end in zip([0, *shared], shared):
            groups.append(([x for x, (s, e) in zip(a, spans_a) if begin <= s < end], [x for x, (s, e) in zip(b, spans_b) if begin <= s < end]))
        for x, (s, e) in zip(a, spans_a):
            links += [(x, y) for y, (u, v) in zip(b, spans_b) if u < e and s < v]
        count.update(links)
        docs.append((i, a, b, groups, links))
    best = {}
    for (x, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return Counter((i, len(a), len(b), len(g), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), brute.sha(text(g)) if g else "") for i, a, b, g, ls in docs), [d[3] for d in docs]


def short(documents):
    return [(i, t) for i, t in documents if len(t or "") < 3000]


def test_query(run, documents):
    """Figures that need no other text, over whole texts; the plain version of long texts is slow."""
    rows = {r.doc_id: r for r in run("op11_alignment")}
    assert len(rows) == len(documents)
    want, _ = plain(short(documents))
    assert {(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in rows.values()} >= {(*w[:5], w[7]) for w in want}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links for r in rows.values())


AWKWARD = [(1, None), (2, ""), (3, " "), (4, "   "), (5, "a "), (6, "a  \n b"), (7, "<|endoftext|> and <s> </s> <unk> <0x0A>"), (8, "x ▁ y"), (9, "日本語 été́ 🎉🎉 \0 ﻿ z"),
           (None, "same row"), (10, "same row"), (10, "same row"), (11, "ﬁ ½ Å x"), (12, "don't re-do it, they'll see 12345 times!!")]


def test_awkward_rows(spark, documents, monkeypatch):
    rows = AWKWARD + [(100 + i, t) for i, t in short(documents)[:40]]
    want, groups = plain(rows)
    monkeypatch.setattr(align, "BLOCK_BYTES", 4000)
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, key int").repartition(3)
    got = align.align(frame, keep=align.keep_digest).collect()
    assert Counter((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, (r.kept or b"").decode()) for r in got) == want
    whole = align.align(frame.where("doc_id = 12 or text = 'a  \\n b'")).collect()
    assert {r.id: align.groups_of(bytes(r.kept), r.n_a, r.n_b) for r in whole} == {i: g for (i, _), g in zip(rows, groups) if i in (6, 12)}
    assert align.align(frame.limit(0)).collect() == []


def test_texts_are_cut_where_no_piece_lies(monkeypatch):
    monkeypatch.setattr(align, "STRETCH", 7)
    tools, rng = align.Tokenizers(A, B, 100), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "日", "<s>", "ing", ". "]) for _ in range(rng.randrange(60)))
        assert tools.encode_b(text).tolist() == tools.b.encode(text)


@pytest.mark.parametrize("share", [0.02, 0.3, 0.9])
def test_run_skipping(share):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 400):
        for _ in range(30):
            a, b = rng.random((2, n)) < 0.5
            same = rng.random(n) > share
            a, b = np.where(same, True, a), np.where(same, True, b)
            a[-1] = b[-1] = True
            ends_a, ends_b = np.flatnonzero(a) + 1, np.flatnonzero(b) + 1
            found = align.Alignment.of(ends_a, ends_b, ends_a, ends_b)
            shared = np.intersect1d(ends_a, ends_b)
            assert (ends_a[found.last_a] == shared).all() and (ends_b[found.last_b] == shared).all()
            every = np.union1d(ends_a, ends_b)
            assert sorted(zip(found.link_a, found.link_b)) == list(zip(np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)))


def test_most_tokens_lie_in_skipped_runs(documents):
    """The method carries the work: on the corpus most tokens are never looked at one by one."""
    tools, skipped, every = align.Tokenizers(A, B, 1000), 0, 0
    for _, text in documents[:40]:
        if text:
            ids_a, ids_b = tools.a.ids(" " + text), tools.encode_b(text)
            runs, walked, _ = align.common_ends(np.cumsum(tools.size_a[ids_a]), np.cumsum(tools.size_b[ids_b]))
            skipped, every = skipped + runs[2].sum(), every + len(ids_a)
    assert skipped > every / 2

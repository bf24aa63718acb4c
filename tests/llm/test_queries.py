"""The registered queries against plain versions over whole tables."""
from collections import Counter, defaultdict

import pytest

from . import brute
from .conftest import DATA
from clubsieve.llm import queries


def test_op1(run, documents):
    rows = run("op1_quality")
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((i, *brute.quality(t)) for i, t in documents)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.p_quality >= 0.5)


def test_op2(run, documents):
    assert Counter(map(tuple, run("op2_simhash"))) == brute.near_copies(documents)


def test_op3(run, spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, DATA, "embeddings").collect()]
    want = brute.nearest(rows)
    got = defaultdict(list)
    for r in sorted(run("op3_nearest"), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in want:
        exact = dict(brute.nearest([x for x in rows], k=len(rows))[q]) if q == min(want) else {}
        for j, s in got[q]:
            assert s == pytest.approx(exact.get(j, s), abs=1e-12)


def test_op5(run, documents):
    assert Counter(map(tuple, run("op5_substrings"))) == brute.substrings(documents)


def test_op6(run, documents):
    at, want = 0, []
    for i, t in sorted(documents, key=lambda d: d[0]):
        tokens = brute.ids("byte_bpe_50k.json", t) + [2]
        want.append((i, at, len(tokens), brute.crc(tokens)))
        at += len(tokens)
    assert sorted(map(tuple, run("op6_token_files"))) == want


def test_op7(run, documents):
    rows = run("op7_packing")
    tokens = {i: brute.ids("word_bpe_49k.json", t) + [2] for i, t in documents}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert brute.crc(tokens[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(tokens[r.doc_id])
    assert set(by_doc) == set(tokens)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(tokens[i])
    full = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        full += at == 4096
    assert full >= len(by_sequence) - 1


def test_op8(run, documents):
    tk = brute.tokenizer("byte_bpe_50k.json")
    want = Counter()
    for i, t in documents:
        ids = brute.ids("byte_bpe_50k.json", t)
        want[i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(tk.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, run("op8_bpe"))) == want


def test_op9(run, spark):
    turns = defaultdict(list)
    for r in queries.table(spark, DATA, "conversations").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", queries.PLANTED), (1, "assistant", queries.PLANTED)]
    want = set()
    for c, rows in turns.items():
        rows.sort()
        said = "".join(t for _, role, t in rows if role == "assistant")
        want.add((c, len(rows), brute.sha("".join(f"{role}\n{t}\n" for _, role, t in rows)), len(said), brute.sha(said)))
    got = run("op9_chat")
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_op10(run, documents):
    for r, (i, t) in zip(sorted(run("op10_secrets"), key=lambda r: r.doc_id), sorted(documents, key=lambda d: d[0])):
        base = brute.secrets(t)
        assert r.doc_id == i and r.base_sha256 == brute.sha(",".join(base))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r.spans.split(",")) | {""}

"""What a task holds at a time does not grow with an Arrow batch or a block of texts."""
import tracemalloc

import numpy as np
import pyarrow as pa

from clubsieve.llm import secrets, words


def test_secrets_hands_back_few_texts_at_a_time():
    texts = [("é token=abcdef12 " + "word " * 400) if i % 7 else None for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    rows, most = [], 0
    for part in secrets.scanned(iter([batch]), ["doc_id", "text"], 1, {}):
        most = max(most, part.num_rows)
        rows += zip(part.column("doc_id").to_pylist(), (t and t[:14] for t in part.column("redacted").to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [(i, "é [secret] word "[:14] if i % 7 else None) for i in range(4000)]
    assert most < 1000 and peak < 12 << 20


def test_hashes_of_a_block_in_stretches():
    rng = np.random.default_rng(3)
    texts = [b" ".join(rng.bytes(int(n)).hex().encode() for n in rng.integers(1, 9, size=4000)) for _ in range(40)] + [b"", b"x" * 400_000, b"a b"]
    words._powers.clear()
    tracemalloc.start()
    data, starts, ends, first = words.of_texts(texts)
    h = words.hashes(data, starts, ends)
    tracemalloc.stop()
    of = lambda word: words.mix(np.array([sum((c + 1) * pow(words._BASE[0], k, 1 << 64) for k, c in enumerate(word)) % (1 << 64)], dtype=np.uint64))[0]
    raw = data.tobytes()
    for i in [0, 1, 77_777, len(starts) // 2, len(starts) - 2, len(starts) - 1]:
        assert h[i] == of(raw[starts[i]:ends[i]])
    at, a, b = words.windows(data, starts, ends, first, 35)
    assert len(at) == 40 * (4000 - 34)
    for i in (0, 5000, len(at) - 1):
        window = [int(x) for x in h[at[i]:at[i] + 35]]
        assert int(a[i]) == int(words.mix(np.array([sum(x * pow(words._BASE[1], k, 1 << 64) for k, x in enumerate(window)) % (1 << 64)], dtype=np.uint64))[0])
    assert sum(p.nbytes for p in words._powers.values()) < 8 << 20

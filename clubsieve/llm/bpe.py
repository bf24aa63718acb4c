"""BPE encoding that reuses content-defined chunks, and decoding by a table of byte strings.

1. A rolling hash over 16 bytes cuts every text into chunks of about 512 bytes; where it cuts depends on the
   bytes alone, so a passage is cut alike in every document that holds it.
2. Chunk hashes are counted over all documents. The chunks that spare most, a stated number of stated size,
   are encoded once in Spark and go to all tasks; chunks are looked up by their bytes, not by hash.
3. A document takes the inside of each known chunk from there and encodes what lies between. A stretch
   reaches one piece into the chunks at its sides; where its ids for that piece differ from those the chunk
   has, the stretch grows by the whole chunk and is encoded again, until both agree.

Everything that is no known chunk is encoded in place, so the result is exact whatever is known.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .tokens import byte_characters, default_path, encoder

WINDOW, CUT_BITS, BASE = 16, 9, 0xA0761D6478BD642F
MOST_CHUNKS, LONGEST_CHUNK = 8192, 2048
SLICE = 1 << 20
REMEMBERED = 150_000  # pre-tokens that a worker keeps; up to four workers run beside each other here
_ANCHOR = re.compile(rb" (?=[!-~])")  # a space before a visible ASCII character always starts a piece


def cuts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The joined bytes, their start per text, and for each text the bounds of its chunks (first 0, last its end)."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(sizes) - sizes
    if len(data) <= WINDOW:
        return data, begins, [np.array([0, n] if n else [0]) for n in sizes.tolist()]
    prefix = np.zeros(len(data) + 1, dtype=W.U64)
    np.cumsum((data.astype(W.U64) + W.U64(1)) * W.powers(BASE, len(data)), dtype=W.U64, out=prefix[1:])
    h = (prefix[WINDOW:-1] - prefix[:-WINDOW - 1]) * W.powers(pow(BASE, -1, 1 << 64), len(data))[:len(data) - WINDOW]
    h = (h ^ (h >> W.U64(32))) * W.U64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(((h >> W.U64(64 - CUT_BITS)) == 0) & ((data[WINDOW:] & 0xC0) != 0x80)) + WINDOW
    out = []
    lo, hi = np.searchsorted(at, begins + WINDOW), np.searchsorted(at, begins + sizes)
    for a, b, begin, n in zip(lo.tolist(), hi.tolist(), begins.tolist(), sizes.tolist()):
        out.append(np.concatenate(([0], at[a:b] - begin, [n])) if n else np.array([0]))
    return data, begins, out


def chunk_hashes(texts: list[bytes]):
    """The joined bytes, and hash, start and end of every chunk that may be shared."""
    data, begins, bounds = cuts(texts)
    none = [np.zeros(0, dtype=np.int64)]
    starts = np.concatenate(none + [b[:-1] + s for b, s in zip(bounds, begins)]).astype(np.int64)
    ends = np.concatenate(none + [b[1:] + s for b, s in zip(bounds, begins)]).astype(np.int64)
    fit = (ends - starts <= LONGEST_CHUNK) & (ends - starts > 64)
    starts, ends = starts[fit], ends[fit]
    return data, W.mix(W.rolling(data, starts, ends, BASE, 1)).view(np.int64), starts, ends


def _slices(batch: pa.RecordBatch, at: int = 0):
    texts = W.text_bytes(batch.column(at))
    for a, b in W.slices(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), SLICE):
        yield texts[a:b]


def shared_chunks(docs: DataFrame, text_col: str = "text", most: int = MOST_CHUNKS) -> DataFrame:
    """chunk (its bytes) of the chunks that spare most encoding: at most `most` of at most 2 KB each."""

    def count(batches):
        for b in batches:
            for texts in _slices(b):
                _, h, start, end = chunk_hashes(texts)
                distinct, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n), pa.array((end - start)[first])], names=["h", "n", "size"])

    texts = docs.select(text_col)
    best = (texts.mapInArrow(count, "h bigint, n bigint, size bigint").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
            .where("n > 1").orderBy(F.desc(F.expr("(n - 1) * size")), "h").limit(most).collect())
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.h for r in best], dtype=np.int64)))

    def fetch(batches):
        want, done = wanted.value, set()
        for b in batches:
            for texts in _slices(b):
                data, h, start, end = chunk_hashes(texts)
                known = np.flatnonzero(np.isin(h, want))
                if not len(known):
                    continue
                new = {data[start[i]:end[i]].tobytes() for i in known} - done
                done |= new
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary())], names=["chunk"])

    return texts.mapInArrow(fetch, "chunk binary").distinct()


def prepare(enc, chunk: bytes):
    """How a chunk is used: ids and places of its inside, and the ids of the pieces next to it; None if it is too short."""
    at = [m.start() for m in _ANCHOR.finditer(chunk)]
    if len(at) < 5:
        return None
    head, inside, last, end = at[0], at[1], at[-2], at[-1]
    part = lambda a, b: enc.encode(chunk[a:b].decode())
    return inside, last, part(head, inside), part(inside, last), part(last, end)


def encode_text(enc, text: bytes, bounds: np.ndarray, known: dict) -> bytes:
    """The ids of a text; known: prepared chunks by their bytes."""
    if not known or any(a.encode() in text for a in enc.added):
        return enc.encode(text.decode())
    done: list[tuple[int, bytes, int, bytes]] = []  # begin of a stretch, its ids, where it ended, inside ids that follow
    begin, tail = 0, b""

    def stretch(a: int, b: int) -> bytes:
        return enc.encode(text[a:b].decode())

    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        use = known.get(text[a:b]) if 64 < b - a <= LONGEST_CHUNK else None
        if use is None:
            continue
        inside, last, head_ids, inside_ids, tail_ids = use
        ids = stretch(begin, a + inside)
        if not ids.endswith(head_ids):
            continue  # the chunk stays part of the stretch
        while done and not ids.startswith(tail):  # take the chunk before into the stretch as well
            begin, tail = done.pop()[0], known_tail(done)
            ids = stretch(begin, a + inside)
        done.append((begin, ids, tail_ids, inside_ids))
        begin, tail = a + last, tail_ids
    ids = stretch(begin, len(text))
    while done and not ids.startswith(tail):
        begin, tail = done.pop()[0], known_tail(done)
        ids = stretch(begin, len(text))
    return b"".join(x + y for _, x, _, y in done) + ids


def known_tail(done: list) -> bytes:
    return done[-1][2] if done else b""


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """id and ids (little-endian integers, as wide as the vocabulary needs) of every row, without special tokens added.

    A null text is empty and has no ids. Repeated rows are encoded each. An empty table gives none. Other
    columns take no part. The chunk table is at most `most_chunks` of 2 KB, so it may go to every task.
    """
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def once(batches):
        enc = encoder(tokenizer, REMEMBERED)
        for b in batches:
            chunks, rows = b.column(0).to_pylist(), []
            for c in chunks:
                p = prepare(enc, c)
                rows.append((c, *p) if p else None)
            rows = [r for r in rows if r]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["chunk", "inside", "last", "head", "ids", "tail"])

    found = shared_chunks(docs, text_col, most_chunks).mapInArrow(once, "chunk binary, inside bigint, last bigint, head binary, ids binary, tail binary").collect()
    table = docs.sparkSession.sparkContext.broadcast({bytes(r.chunk): (r.inside, r.last, bytes(r.head), bytes(r.ids), bytes(r.tail)) for r in found})

    def run(batches):
        enc, known = encoder(tokenizer, REMEMBERED), table.value
        for b in batches:
            ids = []
            for texts in _slices(b, 1):
                bounds = cuts(texts)[2] if known else [None] * len(texts)
                ids += [encode_text(enc, t, c, known) for t, c in zip(texts, bounds)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def byte_table(tokenizer: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; a character without a byte stands for its own UTF-8."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def decoder(tokenizer: str | None = None):
    """A function from the ids of encode() to their text; bytes that are no UTF-8 become U+FFFD."""
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    dtype, piece = encoder(tokenizer).dtype, byte_table(tokenizer).__getitem__
    return lambda ids: b"".join(map(piece, np.frombuffer(ids, dtype=dtype).tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """id, ids and text of every row of encode()."""
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches):
        text = decoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text(x) for x in b.column(1).to_pylist()], pa.string())], names=["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids binary, text string")

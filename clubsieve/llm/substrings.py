"""Exact removal of repeated passages: Rabin-Karp hashes of every window of so many words, counted in Spark.

Texts are cut into blocks of a few MB. A block sends its window hashes packed, one row for each bucket of
hash values, instead of one row per window; equal hashes within the block travel once. Each bucket finds
the hashes that start more than once and answers every block with one bit per hash. The block, which has
travelled compressed with all its columns, then merges the repeated windows into maximal intervals.

A passage that a third of all texts share is spread over as many hashes as it has windows, and each block
sends each of them once, so no bucket grows with it. Windows count as equal if a 64-bit hash and the bucket,
drawn from a second independent hash, are equal: with n windows about n*n / (2**65 * buckets) chance
coincidences are to be expected.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W

BLOCK_BYTES = 4 << 20
ADDED = ("n_words", "n_removed", "removed", "kept_text")


def _blocks(batches, text_at: int, most: int):
    """Consecutive rows with about so many bytes of text, however the batches fall."""
    held, total = [], 0
    for b in batches:
        sizes = [len(t) for t in W.text_bytes(b.column(text_at))]
        begin = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                if i > begin:
                    held.append(b.slice(begin, i - begin))
                yield pa.Table.from_batches(held).combine_chunks()
                held, total, begin = [], 0, i
            total += n
        if len(sizes) > begin:
            held.append(b.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _keyed(texts: list[bytes], width: int, buckets: int):
    """Bounds of words, first words of texts, and per bucket its distinct hashes with the windows they stand for."""
    data, starts, ends, first = W.of_texts(texts)
    at, h, other = W.windows(data, starts, ends, first, width)
    bucket = (other % W.U64(buckets)).astype(np.int32)
    order = np.lexsort((h, bucket))
    h, bucket, at = h[order], bucket[order], at[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
    return data, starts, ends, first, at, h, bucket, new


def _name(block: pa.Table, texts: list[bytes], text_at: int) -> str:
    """A block is known by its contents, so that it is the same one when it is computed again.

    All columns count: blocks of nothing but copies of one text still differ in their ids.
    """
    d = xxhash.xxh3_128()
    for t in texts:
        d.update(len(t).to_bytes(8, "little"))
        d.update(t)
    for k, column in enumerate(block.columns):
        if k != text_at:
            d.update(repr(column.to_pylist()).encode("utf-8", "surrogatepass"))
    return d.hexdigest()


def _packed(docs: DataFrame, text_at: int, width: int, buckets: int) -> DataFrame:
    def run(batches):
        for block in _blocks(batches, text_at, BLOCK_BYTES):
            texts = W.text_bytes(block.column(text_at))
            *_, h, bucket, new = _keyed(texts, width, buckets)
            at = np.flatnonzero(new)
            if not len(at):
                continue
            again = np.diff(np.append(at, len(h))) > 1
            distinct, of = h[at], bucket[at]
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            stop = np.append(cut[1:], len(of))
            yield pa.RecordBatch.from_arrays([
                pa.array([_name(block, texts, text_at)] * len(cut)), pa.array(of[cut], pa.int32()),
                pa.array([distinct[a:b].astype("<u8").tobytes() for a, b in zip(cut, stop)], pa.binary()),
                pa.array([np.packbits(again[a:b]).tobytes() for a, b in zip(cut, stop)], pa.binary()),
            ], names=["block", "bucket", "hashes", "again"])

    return docs.mapInArrow(run, "block string, bucket int, hashes binary, again binary")


def _answer(group: pa.Table) -> pa.Table:
    """For each row of a bucket, a bit per hash: does it start more than once anywhere?"""
    rows = [np.frombuffer(x, dtype="<u8") for x in group.column("hashes").to_pylist()]
    sizes = np.array([len(r) for r in rows])
    again = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(group.column("again").to_pylist(), sizes)]).astype(bool)
    every = np.concatenate(rows)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(every), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    marked = again.copy()
    marked[order] |= twice
    # A hash that repeats within one block is marked there; others that hold it are equal neighbours anyway.
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    bits = [np.packbits(marked[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "marks": pa.array(bits, pa.binary())})


def _stored(docs: DataFrame, text_at: int) -> DataFrame:
    def run(batches):
        for block in _blocks(batches, text_at, BLOCK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(block)
            name = _name(block, W.text_bytes(block.column(text_at)), text_at)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    return docs.mapInArrow(run, "block string, rows binary")


def without_repeated_windows(docs: DataFrame, text_col: str = "text", width: int = 35, buckets: int | None = None) -> DataFrame:
    """All columns of docs, and n_words, n_removed, removed (maximal word intervals, end exclusive) and kept_text.

    A word goes if a window of `width` consecutive words that covers it has a sequence that starts anywhere
    else as well, in the same text or another; kept words are joined by one space. A null text has no words
    and an empty kept_text. Texts of fewer words stay whole. Repeated rows remove each other's windows. The
    order of rows is of no account. Columns of docs that bear an added name are replaced.
    """
    spark = docs.sparkSession
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(*names)
    text_at = names.index(text_col)
    answers = _packed(docs, text_at, width, buckets).groupBy("bucket").applyInArrow(_answer, "block string, bucket int, marks binary")
    added = T._parse_datatype_string("n_words bigint, n_removed bigint, removed array<struct<start: bigint, end: bigint>>, kept_text string")
    schema = T.StructType([*docs.schema.fields, *added.fields])

    def finish(key, left, right):
        marks = dict(zip(right.column("bucket").to_pylist(), right.column("marks").to_pylist()))
        out = []
        for rows in left.column("rows").to_pylist():
            block = pa.ipc.open_stream(rows).read_all()
            texts = W.text_bytes(block.column(text_at))
            data, starts, ends, first, at, h, bucket, new = _keyed(texts, width, buckets)
            gone = np.zeros(len(starts) + 1, dtype=np.int64)
            if len(h):
                of = bucket[new]
                cut = np.flatnonzero(np.diff(of, prepend=-1))
                stop = np.append(cut[1:], len(of))
                bits = [np.unpackbits(np.frombuffer(marks[int(of[a])], dtype=np.uint8), count=b - a) for a, b in zip(cut, stop)]
                repeated = at[np.concatenate(bits).astype(bool)[np.cumsum(new) - 1]]
                gone[repeated] += 1  # each window stands here once
                gone[repeated + width] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            raw = data.tobytes()
            n_words, n_removed, removed, kept = [], [], [], []
            for i in range(len(texts)):
                a, b = first[i], first[i + 1]
                mask = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                n_words.append(b - a)
                n_removed.append(int(mask.sum()))
                removed.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2])])
                keep = [0, *edge.tolist(), int(b - a)]
                parts = [raw[starts[a + x]:ends[a + y - 1]] for x, y in zip(keep[0::2], keep[1::2]) if y > x]
                kept.append(b" ".join(w for p in parts for w in p.split()).decode())
            columns = [block.column(c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                       pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
            out.append(pa.table(columns, names=[*names, *added.names]))
        if not out:
            raise RuntimeError(f"block {key} came out otherwise when it was computed again")
        return pa.concat_tables(out)

    return _stored(docs, text_at).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)

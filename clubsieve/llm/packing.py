"""Packing by concatenation: documents lie one after the other and are cut into windows of equal length.

Two passes. The first encodes every document and notes how many ids its partition holds before it; the
totals per partition, added up, are the global offset of each partition. The second cuts: a document that
crosses a window's end gets a boundary record, a further piece at offset 0 of the next sequence. Only the
last sequence can be short, so there is no padding besides.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .token_files import new_folder
from .tokens import default_path, encoder
from .words import parts


def pack(docs: DataFrame, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Pieces: id, start, length, ids (little-endian, four bytes each), doc_tokens, sequence_id, offset.

    Every id of every row lies in exactly one piece; a null or empty text is its end id alone. Rows with
    equal ids are packed each. An empty table gives no piece. Other columns of docs take no part. The
    encoded rows are written once, so that a lost executor cannot change offsets already handed out; the
    totals, one per partition, are added up on the driver.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path("word_bpe_49k.json")
    dtype = encoder(tokenizer).dtype

    def first(batches):
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for b in parts(batches, 1):
            ids = [enc.encode(t) + end for t in b.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // enc.dtype.itemsize
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())],
                                             names=["id", "part", "before", "n", "ids"])

    folder = new_folder(spark)
    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
     .mapInArrow(first, "id bigint, part int, before bigint, n bigint, ids binary").write.option("compression", "zstd").parquet(folder))
    encoded = spark.read.schema("id bigint, part int, before bigint, n bigint, ids binary").parquet(folder)
    base, at = {}, 0
    for r in sorted(encoded.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base[r.part], at = at, at + r.n

    def second(batches):
        for b in parts(batches, 4):
            out: list[list] = [[] for _ in range(7)]
            for i, part, before, n, ids in zip(*[c.to_pylist() for c in b.columns]):
                tokens, begin, done = np.frombuffer(ids, dtype=dtype).astype("<u4"), base[part] + before, 0
                while done < n:
                    sequence, offset = divmod(begin + done, length)
                    take = min(n - done, length - offset)
                    for column, x in zip(out, (i, done, take, tokens[done:done + take].tobytes(), n, sequence, offset)):
                        column.append(x)
                    done += take
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return encoded.mapInArrow(second, "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def padded_length(n: int, length: int = 4096) -> int:
    """What a sequence of n ids is filled up to: its own size at a power of two, else the whole length."""
    return n if n & (n - 1) == 0 else length


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids (four bytes each, filled up with pad_id). A group is one sequence, so at most `length` ids."""

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("offset").to_pylist(), group.column("ids").to_pylist()))
        ids = b"".join(x for _, x in rows)
        n = len(ids) // 4
        ids += np.full(padded_length(n, length) - n, pad_id, dtype="<u4").tobytes()
        return pa.table({"sequence_id": group.column("sequence_id")[:1], "n_tokens": pa.array([n], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id bigint, n_tokens bigint, ids binary")

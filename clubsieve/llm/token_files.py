"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Layout of a folder, both parts Parquet so that any store Spark can reach will do:

* `vocabulary`: rank, token, n: the more frequent an id in the whole corpus, the smaller its rank;
* `blocks`: rows of about a million ids in ascending id order of documents: shard, block, tokens before it
  in the shard, document ids, id counts, control bytes and data bytes.

A control byte holds four two-bit lengths (1 to 4 bytes), the data bytes are the ranks without leading zero
bytes. A document is filled up to four ids, so whole blocks decode at once by table lookup.
"""
from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tokens import default_path, encoder

BLOCK_TOKENS = 1 << 20
#: Lengths of the four ids of each control byte, and which bits of a four-byte word a length keeps.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks, whose number is a multiple of four."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = code.reshape(-1, 4).astype(np.uint8)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes) -> np.ndarray:
    """Ranks of control and data bytes, by table lookup."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)
    begin = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    word = raw[begin] | raw[begin + 1] << 8 | raw[begin + 2] << 16 | raw[begin + 3] << 24
    return word & KEEP[size]


def token_table(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """id, ids (little-endian, as wide as the vocabulary needs, with the end id) for every row; null text is empty."""

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for b in batches:
            ids = [enc.encode(t) + end for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, ids binary")


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> None:
    """Writes all rows of docs as token files, in ascending id order (null ids first; equal ids by their tokens).

    Ids are counted over the whole corpus; only the count per vocabulary entry reaches the driver. An empty
    table gives an empty vocabulary and no blocks. Other columns of docs take no part.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    dtype = encoder(tokenizer).dtype
    raw = f"{folder}/ids"
    token_table(docs, id_col, text_col, tokenizer, end_id).write.option("compression", "zstd").parquet(raw)
    tokens = spark.read.schema("id bigint, ids binary").parquet(raw)

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            seen = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=dtype))
            total, seen = (total, seen) if len(total) >= len(seen) else (seen, total)
            total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    counts = (tokens.select("ids").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "token").collect())  # at most the vocabulary
    spark.createDataFrame([(i, r.token, r.n) for i, r in enumerate(counts)], "rank bigint, token bigint, n bigint") \
        .coalesce(1).write.parquet(f"{folder}/vocabulary")
    rank_of = np.zeros(max([r.token for r in counts], default=0) + 1, dtype=np.uint32)
    for i, r in enumerate(counts):
        rank_of[r.token] = i
    ranks = spark.sparkContext.broadcast(rank_of)  # at most the vocabulary

    def blocks(batches):
        table, shard, number, before = ranks.value, TaskContext.get().partitionId(), 0, 0
        ids, sizes, held, total = [], [], [], 0

        def block():
            control, data = pack(np.concatenate(held))
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
            ], names=["shard", "block", "before", "tokens", "ids", "sizes", "control", "data"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = table[np.frombuffer(x, dtype=dtype)]
                ids.append(i)
                sizes.append(len(r))
                held += [r, np.zeros(-len(r) % 4, dtype=np.uint32)]
                total += len(r)
                if total >= BLOCK_TOKENS:
                    yield block()
                    number, before = number + 1, before + total
                    ids, sizes, held, total = [], [], [], 0
        if ids:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (tokens.repartitionByRange(parts, "id").sortWithinPartitions("id", "ids")
     .mapInArrow(blocks, "shard int, block int, before bigint, tokens bigint, ids array<bigint>, sizes array<bigint>, control binary, data binary")
     .write.option("compression", "zstd").parquet(f"{folder}/blocks"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and ids (little-endian, four bytes each) from the files.

    The totals of the shards, as many as the writer had partitions, are added up on the driver.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("tokens").alias("n")).collect()}
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard], at = at, at + totals[shard]
    words = spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()
    vocabulary = spark.sparkContext.broadcast(np.array([r.token for r in words], dtype="<u4"))

    def run(batches):
        tokens = vocabulary.value
        for b in batches:
            for row in b.to_pylist():
                every = tokens[unpack(row["control"], row["data"])]
                sizes = np.array(row["sizes"], dtype=np.int64)
                begin = np.cumsum(sizes + -sizes % 4) - (sizes + -sizes % 4)
                start = base[row["shard"]] + row["before"] + np.cumsum(sizes) - sizes
                ids = [every[a:a + n].tobytes() for a, n in zip(begin.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(start), pa.array(sizes), pa.array(ids, pa.binary())],
                                                 names=["id", "start", "n_tokens", "ids"])

    return blocks.select("shard", "before", "ids", "sizes", "control", "data").mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A folder for token files below the shared one."""
    import uuid

    from ..session import shared_folder
    return os.path.join(shared_folder(spark), f"tokens-{uuid.uuid4()}")

"""Importance resampling towards a target: hashed word runs, gains per bucket, a draw by Gumbel keys.

1. Head: words, and for runs of two and more also pairs, are counted over the whole corpus. The most frequent
   ones, a stated number of stated length, go to all tasks with their CRC state (words) or bucket (pairs).
2. Tail: whatever is not in the head is hashed directly; a longer run continues from the state of its first
   word. Both give the same CRC, so bucket totals are exact whatever the head holds.
3. Totals of corpus and target give each bucket's gain, documents their mean gain, and a key per document
   turns that into a weighted draw without replacement. Documents are sorted once, by ranges of the key;
   ranks are places in a range plus the rows of the ranges before it.

The corpus is encoded once: features travel to a written table as bucket numbers.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .token_files import new_folder

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LONGEST = 64  # bytes of a word or pair of the head
LEVELS = 16
HELD = 200_000  # distinct strings that a task counts before it sends them on


def split(text: bytes) -> list[bytes]:
    """Words of a text: only A-Z are lower-cased; ASCII digits, letters and all other characters make words."""
    return WORD.findall(text.translate(_LOWER))


def frequent(texts: DataFrame, width: int, most: int) -> list[bytes]:
    """The most frequent runs of so many words among those of at most LONGEST bytes that occur twice or more.

    Counts are graded by their logarithm, LEVELS grades to the doubling; the head is made of whole grades, as many as
    come to `most` runs together, so the driver gets no more than these and one number per grade.
    """

    def count(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["run", "n"])

        for b in batches:
            for text in W.text_bytes(b.column(0)):
                found = split(text)
                if width > 1:
                    found = [b" ".join(found[i:i + width]) for i in range(len(found) - width + 1)]
                held.update(found)
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    folder = new_folder(texts.sparkSession)
    (texts.mapInArrow(count, "run binary, n bigint").where(F.octet_length("run") <= LONGEST).groupBy("run").agg(F.sum("n").alias("n")).where("n > 1")
     .withColumn("level", F.floor(F.log2("n") * LEVELS).cast("int")).write.parquet(folder))
    counted = texts.sparkSession.read.schema("run binary, n bigint, level int").parquet(folder)
    least, total = None, 0
    for r in sorted(counted.groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r.level
    return [bytes(r.run) for r in counted.where(F.col("level") >= least).select("run").collect()] if least is not None else []


class Hasher:
    """Bucket numbers of all runs of 1 to `longest` words."""

    def __init__(self, head: list[bytes], pairs: list[bytes], longest: int, buckets: int):
        self.state = {w: zlib.crc32(w) for w in head}
        self.pair = {p: zlib.crc32(p) % buckets for p in pairs}
        self.longest, self.buckets = longest, buckets

    def features(self, found: list[bytes]) -> np.ndarray:
        """Runs of one word first, then runs of two, and so on."""
        states = list(map(self.state.get, found))
        if None in states:  # the tail
            states = [zlib.crc32(w) if s is None else s for w, s in zip(found, states)]
        out = [np.array(states, dtype=np.int64) % self.buckets]
        for width in range(2, self.longest + 1):
            if len(found) < width:
                break
            last = found[width - 1:]
            if width == 2:
                known = [self.pair.get(a + b" " + b) for a, b in zip(found, last)]
                states = [zlib.crc32(b" " + b, s) for s, b in zip(states, last)] if self.longest > 2 or None in known else []
                out.append(np.array([s % self.buckets if k is None else k for k, s in zip(known, states or known)], dtype=np.int64))
            else:
                states = [zlib.crc32(b" " + b, s) for s, b in zip(states, last)]
                out.append(np.array(states, dtype=np.int64) % self.buckets)
        return np.concatenate(out)


def _encoded(texts: DataFrame, kind: str, hasher) -> DataFrame:
    """row (unique), id, n_words and features of every row of (id, text), written once."""
    dtype = np.dtype("<u2" if hasher.value.buckets <= 1 << 16 else "<u4")

    def run(batches):
        row, make = TaskContext.get().partitionId() << 40, hasher.value
        for b in batches:
            n_words, features = [], []
            for text in W.text_bytes(b.column(1)):
                found = split(text)
                n_words.append(len(found))
                features.append(make.features(found).astype(dtype).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(n_words)), pa.int64()), b.column(0), pa.array(n_words, pa.int64()), pa.array(features, pa.binary())], names=["row", "id", "n_words", "features"])
            row += len(n_words)

    schema = f"row bigint, id {kind}, n_words bigint, features binary"
    folder = new_folder(texts.sparkSession)
    texts.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return texts.sparkSession.read.schema(schema).parquet(folder)


def bucket_totals(encoded: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; a task sends one row per bucket at most."""
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, dtype=dtype), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    total = np.zeros(buckets, dtype=np.int64)
    for r in encoded.select("features").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the logarithm of target share over corpus share, one added to every count, floored."""
    all_corpus, all_target, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1, buckets: int = 10_000,
             percent: int = 10, least_words: int = 20, seed: int = 2024, head: int = 65_536, head_pairs: int = 65_536) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (null unless drawn) of every row.

    weight is the floored mean gain of a document's features, 0 without any; score adds a Gumbel key made of
    seed and id. Of the N rows with `least_words` words or more the floor(percent * N / 100) highest scores are
    drawn, ties to the smaller id (null last), then to the order of rows. A null id is hashed as an empty one.

    A null or empty text has no words. Repeated rows count each and may each be drawn. An empty corpus gives no
    rows; an empty target leaves gains to the corpus alone. Very long texts are hashed whole. Other columns take
    no part. The driver holds at most `head` and `head_pairs` strings of LONGEST bytes, `buckets` totals, and
    one number per range of the sort.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = frequent(texts.select("text"), 1, head)
    pairs = frequent(texts.select("text"), 2, head_pairs) if longest > 1 else []
    hasher = spark.sparkContext.broadcast(Hasher(words, pairs, longest, buckets))
    encoded = _encoded(texts, kind, hasher)
    wanted = _encoded(target.select(F.lit(None).cast(kind).alias("id"), F.col(target_text_col).alias("text")), kind, hasher)
    gain = spark.sparkContext.broadcast(gains(bucket_totals(encoded, buckets), bucket_totals(wanted, buckets)))
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def weigh(batches):
        for b in batches:
            rows = [np.frombuffer(x, dtype=dtype) for x in b.column(3).to_pylist()]
            n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            sums = np.fromiter((gain.value[x].sum() for x in rows), dtype=np.int64, count=len(rows))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n), pa.array(sums // np.maximum(n, 1))], names=["row", "id", "n_words", "n_features", "weight"])

    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = (encoded.mapInArrow(weigh, f"row bigint, id {kind}, n_words bigint, n_features bigint, weight bigint")
              .withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))).withColumn("fits", F.col("n_words") >= least_words))
    columns = scored.columns
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at, at + n))], names=[*columns, "part", "place"])
            at += n

    schema = f"row bigint, id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint, fits boolean, part int, place bigint"
    folder = new_folder(spark)
    scored.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema).write.parquet(folder)
    placed = spark.read.schema(schema).parquet(folder)
    before, at, fitting = {}, 0, 0
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fits").alias("fits")).collect()):
        before[r.part], at, fitting = at, at + r.n, fitting + r.fits
    drawn = percent * fitting // 100

    def rank(batches):
        for b in batches:
            part, place = b.column(7).to_numpy(), b.column(8).to_numpy()
            at = np.fromiter(map(before.__getitem__, part.tolist()), dtype=np.int64, count=len(part)) + place + 1
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in (1, 2, 3, 4, 5)], pa.array(at, mask=at > drawn)], names=["id", "n_words", "n_features", "weight", "score", "rank"])

    return placed.mapInArrow(rank, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint, rank bigint")

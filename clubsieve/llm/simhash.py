"""SimHash fingerprints and their near copies by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits of each other meet at a point at most radius/2 from both. So each
emits every variant within radius/2, variants are the join key, and whatever collides is linked.

For 64 bits and radius 4 that is 2081 variants per fingerprint, over ten times the input as shuffle. The
fingerprint is therefore first cut into three parts. Of four differing bits at least two fall into one
part, or the other two parts differ in two at most; so two near fingerprints always have a pair of parts
in which they differ by two bits at most, and meet there within one: 132 variants in all. Each group of
equal variants is linked to its least member if that is near. If any member of a group is not near to the
least one, all fingerprints of that group go through the plain form with all 2081 variants, where
everything that shares a variant lies within the radius and a star of links loses nothing. No form
compares all members of a group with each other.

These tables grow with the input and Spark guesses the size of exploded rows too low, so no join may broadcast.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import settle
from .components import components
from .words import parts, text_bytes

BITS = 64
SEED = 42
_ONES = np.arange(64, dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes, width: int = 4) -> int:
    """Unsigned 64-bit SimHash over the word shingles of a text (A-Z lowered); no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    stops = ends[width - 1:].tolist() if len(words) >= width else [len(joined)]
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, 1 << 15):
        h = np.array([hash_of(joined[a:b], SEED) for a, b in zip(begins[lo:lo + (1 << 15)], stops[lo:lo + (1 << 15)])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > n).astype(np.uint64) << _ONES).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id, fp (64-bit, signed as Spark holds it) for every row. A null text has no words."""

    def run(batches):
        for b in parts(batches, 1):
            fps = [_signed(fingerprint(t, width)) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def flips(bits: list[int], most: int) -> list[int]:
    """Masks with at most so many of the given bits set, as signed integers."""
    return [_signed(sum(1 << i for i in c)) for k in range(most + 1) for c in combinations(bits, k)]


def _variants(fps: DataFrame, keep: list[int], most: int) -> DataFrame:
    """key, fp: the kept bits of every fingerprint with at most so many of them turned."""
    inside = _signed(sum(1 << i for i in keep))
    masks = F.expr("array(" + ",".join(f"{m}L" for m in flips(keep, most)) + ")")
    return fps.select(F.explode(masks).alias("mask"), "fp").select(F.col("fp").bitwiseAND(F.lit(inside)).bitwiseXOR(F.col("mask")).alias("key"), "fp")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = 4, parts: int = 3) -> DataFrame:
    """Links a, b between distinct fingerprints; their components are those of "at most radius bits apart".

    fps: one column fp without repeats. parts=1 is the plain form; parts=3 comes to the same components.
    """
    if radius % 2 or radius < 2 or parts not in (1, 3):
        raise ValueError("an even radius, and 1 or 3 parts")
    order = Window.partitionBy("key").orderBy("fp")  # the least of a group, without holding the group
    if parts == 1:
        ball = _variants(fps, list(range(BITS)), radius // 2)
        return ball.select(F.first("fp").over(order).alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()
    left = radius - -(-radius // 3)  # what two of the three parts have between them at most
    third = [list(range(0, 21)), list(range(21, 42)), list(range(42, 64))]
    keyed = None  # keys of different pairs of parts may coincide; that only adds a candidate
    for pair in combinations(third, 2):
        one = _variants(fps, [*pair[0], *pair[1]], -(-left // 2))
        keyed = one if keyed is None else keyed.unionByName(one)
    met = settle(keyed.select("key", F.first("fp").over(order).alias("a"), F.col("fp").alias("b")).where("a <> b")
                 .withColumn("near", distance(F.col("a"), F.col("b")) <= radius))
    stars = met.where("near").select("a", "b")
    odd = met.where("not near").select("key").distinct()
    rest = met.join(odd.hint("merge"), "key", "left_semi").select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    return stars.unionByName(links(rest, radius, 1)).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, parts: int = 3) -> DataFrame:
    """id, fp and component (smallest id reachable over near fingerprints) for every row.

    Null and empty texts have fingerprint zero and are linked like others. Repeated rows give repeated rows.
    An empty table gives an empty result. Other columns of docs take no part.
    """
    fps = settle(fingerprints(docs, id_col, text_col, width))
    least = settle(fps.groupBy("fp").agg(F.min("id").alias("least")))
    group = components(links(least.select("fp"), radius, parts), "a", "b")
    named = least.join(group.hint("merge"), least.fp == group.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    smallest = named.groupBy("c").agg(F.min("least").alias("component"))
    classes = named.join(smallest.hint("merge"), "c").select("fp", "component")
    return fps.join(classes.hint("merge"), "fp").select("id", "fp", "component")

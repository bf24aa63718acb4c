"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector, scaled to length one, is turned by a random rotation (short vectors into more dimensions than
they have, so that a code has at least 1024 bits) and keeps the signs of its components, packed into 64-bit
words, and one correction scalar: the inner product of the turned vector with its own code. A query keeps four
bits per component. Counting common bits gives the inner product of query and code; divided by the scalar it
estimates the cosine, with a bound on its error.

Every vector is coded once. Codes, not vectors, meet the coded queries in a grid of cells and query blocks of
bounded size, twice: first for the k best lower bounds of each cell, which give one k-th bound per query over
all cells, then for the vectors whose upper bound reaches it. Only those are joined with their vectors and
measured exactly.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from ..session import settle

CODES_PER_CELL, QUERIES_PER_BLOCK, LEAST_CELLS = 8192, 2048, 32
LEAST_BITS = 1024  # of a code; the error of an estimate falls with the root of it
SURE = 3.0  # how many standard deviations the bound holds
QUERY_BITS = 4


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """Orthonormal rows of a random rotation, the same for every task; its size is a multiple of 64."""
    size = max(LEAST_BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, dim)))
    return (q * np.sign(np.diag(r))).T


def _turned(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1)[:, None]
    v = vectors / largest  # squares of very large or small components stay finite
    return (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ turn


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words) and correction scalars of vectors."""
    turned = _turned(vectors, turn)
    return np.packbits(turned > 0, axis=1, bitorder="little").view("<u8"), np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])


def query_codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (query, plane, word) of the rounded components of turned queries, their least value and step."""
    turned = _turned(vectors, turn)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([np.packbits(level >> k & 1, axis=1, bitorder="little").view("<u8") for k in range(QUERY_BITS)], axis=1)
    return planes, low, step


def estimate(words: np.ndarray, scalar: np.ndarray, planes: np.ndarray, low: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of one query with all codes and the bound on their error, from packed bits alone.

    words: the codes with one row per word, so that counts add up along whole rows.
    """
    size = 64 * len(words)
    common, level = np.zeros(words.shape[1], dtype=np.int64), 0
    for k, plane in enumerate(planes):
        common += np.bitwise_count(words & plane[:, None]).sum(axis=0, dtype=np.uint16).astype(np.int64) << k
        level += int(np.bitwise_count(plane).sum()) << k
    ones = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
    product = (2 * (low * ones + step * common) - (low * size + step * level)) / np.sqrt(size)
    rounding = step * step / 12  # variance of a rounded component
    error = SURE * np.sqrt(np.maximum(1 - scalar ** 2, 0) / (size - 1) + rounding) / scalar
    return product / scalar, error


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (in its own type) of the rows with an id and a vector that is not null, not zero, and all finite."""
    wide = F.col("v").cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.exists(wide, lambda x: x != 0))


def _coded(rows: DataFrame, seed: int, queries: bool) -> DataFrame:
    """One code per row: id, tag, dim and bits with scalar, or planes with low and step."""

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            dims, out = np.array(b.column("dim")), []
            for dim in np.unique(dims).tolist():
                t = pa.table(b).filter(pa.array(dims == dim))
                if dim not in turns:
                    turns = {dim: rotation(dim, seed)}  # one at a time, whatever lengths there are
                v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                bits, *scalars = (query_codes if queries else codes)(v, turns[dim])
                packed = pa.array([x.tobytes() for x in bits], pa.binary())
                out.append(pa.table([t.column("id"), t.column("tag"), t.column("dim"), packed, *map(pa.array, scalars)], names=names))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    names = ["id", "tag", "dim", "bits", *(("low", "step") if queries else ("scalar",))]
    schema = "id bigint, tag bigint, dim int, bits binary, " + ", ".join(f"{n} double" for n in names[4:])
    return rows.select("id", "tag", "dim", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, schema)


def _bounds(left: pa.Table, right: pa.Table):
    """For every query of a block: its place there, the estimates of all codes of the cell and their errors."""
    words = np.frombuffer(b"".join(left.column("bits").to_pylist()), "<u8").reshape(left.num_rows, -1).T.copy()
    scalar, ids = left.column("scalar").to_numpy(), left.column("id").to_numpy()
    low, step, own = (right.column(c).to_numpy() for c in ("low", "step", "id"))
    for i, planes in enumerate(right.column("bits").to_pylist()):
        guess, error = estimate(words, scalar, np.frombuffer(planes, "<u8").reshape(QUERY_BITS, -1), low[i], step[i])
        yield i, ids != own[i], guess, error


def _columns(schema: dict, parts: list) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * len(schema)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(schema.items(), cols)})


def candidates(rows: DataFrame, queries: DataFrame, n: int, q: int, k: int, seed: int = 7) -> DataFrame:
    """query_id, query_tag, vec_id, vec_tag: the pairs that the bounds on codes leave to be measured."""
    cells, blocks = max(LEAST_CELLS, -(-n // CODES_PER_CELL)), max(1, -(-q // QUERIES_PER_BLOCK))
    place = lambda count, salt: F.pmod(F.xxhash64("id", "tag", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    base = settle(_coded(rows, seed, False)).select("*", place(cells, 0).alias("cell"), every(blocks).alias("block"))
    coded = settle(_coded(queries, seed, True))
    grid = ("dim", "cell", "block")

    def meet(ask: DataFrame, one, schema: dict, ddl: str) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return _columns(schema, one(left, right) if left.num_rows and right.num_rows else [])

        spread = ask.select("*", every(cells).alias("cell"), place(blocks, 1).alias("block"))
        return base.groupBy(*grid).cogroup(spread.groupBy(*grid)).applyInArrow(run, ddl)

    def lows(left, right):
        out, ids = [], right.column("id").to_numpy()
        for i, other, guess, error in _bounds(left, right):
            low = (guess - error)[other]
            out.append((np.full(min(k, len(low)), ids[i]), low if len(low) <= k else np.partition(low, -k)[-k:]))
        return out

    def reach(left, right):
        out, ids, tags, kth = [], *(right.column(c).to_numpy() for c in ("id", "tag", "kth"))
        vec_ids, vec_tags = left.column("id").to_numpy(), left.column("tag").to_numpy()
        for i, other, guess, error in _bounds(left, right):
            at = np.flatnonzero(other & (guess + error >= kth[i]))
            out.append((np.full(len(at), ids[i]), np.full(len(at), tags[i]), vec_ids[at], vec_tags[at]))
        return out

    first = meet(coded, lows, {"id": pa.int64(), "low": pa.float64()}, "id bigint, low double")
    order = Window.partitionBy("id").orderBy(F.desc("low"))
    kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("id").agg(F.max("r").alias("r"), F.min("low").alias("bound"))
    bound = F.when(F.col("r") == k, F.col("bound")).otherwise(float("-inf"))  # fewer than k vectors: all of them
    ask = settle(coded.join(kth, "id", "left").select(*coded.columns, bound.alias("kth")))
    pairs = {n: pa.int64() for n in ("query_id", "query_tag", "vec_id", "vec_tag")}
    return meet(ask, reach, pairs, ", ".join(f"{n} bigint" for n in pairs))


def nearest(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine for every query row; ties go to smaller ids.

    is_query: a column over `id`. A query's own id is no candidate. Vectors that are null, empty, zero or not
    finite take no part; a query meets the vectors of its own length. Of repeated rows with one id and vector one
    counts; rows of one id with different vectors are each a candidate, so such an id may be listed more than
    once, and the k best of all vectors of a query id are kept. A table without queries gives no row. Other
    columns take no part.

    Each code (144 bytes up to 1024 dimensions) is copied to every query block and each coded query to every
    cell, so work grows with the product of rows and queries, by a count of common bits for each pair; memory is
    bounded by one cell and one block. Whole vectors only meet for the pairs that the bounds leave.
    """
    rows = settle(usable(table, id_col, vector_col).dropDuplicates().withColumns({"tag": F.xxhash64("v"), "dim": F.size("v")}))
    queries = rows.where(is_query)
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    found = candidates(rows, queries, size.n, size.q, k, seed)
    wide = lambda c: F.col(c).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot(wide("v"), wide("v")))
    ask = queries.select(F.col("id").alias("query_id"), F.col("tag").alias("query_tag"), F.col("v").alias("q"), length.alias("q_length"))
    base = rows.select(F.col("id").alias("vec_id"), F.col("tag").alias("vec_tag"), "v", length.alias("v_length"))
    pairs = found.join(base, ["vec_id", "vec_tag"]).join(ask, ["query_id", "query_tag"])
    scored = pairs.select("query_id", "vec_id", (dot(wide("q"), wide("v")) / F.col("q_length") / F.col("v_length")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

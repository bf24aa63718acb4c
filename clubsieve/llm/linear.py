"""Linear text classifiers over hashed word and character n-grams, as a chain of one or more labels.

Training reads a bounded sample of the labelled rows, the `rows` with the least hashed ids. Features are
hashes of words and of byte n-grams; those whose document frequency differs most between the labels are
kept. Every label has a logistic regression whose scores are calibrated on out-of-fold predictions, and the
out-of-fold probabilities of a label are features of the labels after it. Scoring reads whole texts.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from . import words as W

SLICE = 1 << 20
BLOCK = 1 << 14  # hash values whose counts are summed in one task
STRIP = 256  # rows of the training matrix that stay in cache between its two products


@dataclass(frozen=True)
class Plan:
    """What a model reads and how it is fitted; `rows` bounds the sample, `features` the weights."""
    labels: tuple[str, ...]
    grams: tuple[int, ...] = (4, 5)
    bits: int = 20
    rows: int = 10_000
    features: int = 2048
    folds: int = 5
    lower: bool = True
    rate: bool = False  # weigh counts by the length of the text
    steps: int = 400
    penalty: float = 1e-4


@dataclass(frozen=True)
class Model:
    plan: Plan
    slot: np.ndarray  # hash value to feature, 0 for none
    layers: tuple[tuple[np.ndarray, float, float, float], ...]  # weights, bias and the calibration's slope and shift


def hashed(texts: list[bytes], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash value of every word and n-gram, and how many each text has. No n-gram crosses texts."""
    data = np.frombuffer(b" " + b" ".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    shift = np.uint64(64 - plan.bits)
    starts, ends = W.bounds(data)
    docs, values = [of[starts]], [(W.hashes(data, starts, ends) >> shift).astype(np.uint32)]
    for n in plan.grams:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k:k + m]
        inside = of[:m] == of[n - 1:]
        docs.append(of[:m][inside])
        values.append(((h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.uint32))
    docs, values = np.concatenate(docs), np.concatenate(values)
    return docs, values, np.bincount(docs, minlength=len(texts))


def counted(docs: np.ndarray, slots: np.ndarray, totals: np.ndarray, width: int, plan: Plan):
    """Text number, feature and weight of every feature of every text."""
    pairs, n = np.unique(docs.astype(np.int64) * width + slots, return_counts=True)
    of, slot = np.divmod(pairs, width)
    return of, slot, np.log1p(n * (1000.0 / totals[of]) if plan.rate else n).astype(np.float32)


def _prepared(batch: pa.RecordBatch, at: int, plan: Plan):
    texts = W.text_bytes(batch.column(at))
    if plan.lower:
        texts = [t.lower() for t in texts]
    for a, b in W.slices(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), SLICE):
        yield a, b, texts[a:b]


def logistic(x: np.ndarray, y: np.ndarray, use: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of regularised logistic regressions, one per column of `use`, by Adam over the rows it marks.

    All of them walk the rows together, so no subset of x is copied and x is read once a step.
    """
    n = use.sum(axis=0)
    share = use / np.maximum(1, n)
    rate = np.where(n > 0, y @ share, 0.5)
    w, m, v = (np.zeros((x.shape[1] + 1, use.shape[1]), dtype=np.float64) for _ in range(3))
    w[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    for t in range(1, plan.steps + 1):
        w32, g = w[:-1].astype(np.float32), plan.penalty * w
        g[-1] = 0
        for i in range(0, len(x), STRIP):
            strip = x[i:i + STRIP]
            p = 1 / (1 + np.exp(-np.clip(strip @ w32 + w[-1], -30, 30)))
            d = ((p - y[i:i + STRIP, None]) * share[i:i + STRIP]).astype(np.float32)
            g[:-1] += strip.T @ d
            g[-1] += d.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w[:-1], w[-1]


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities, by Newton's method on smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        g = np.array([(d * score).sum(), d.sum()])
        hess = np.array([[(h * score * score).sum(), (h * score).sum()], [(h * score).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


def probability(score: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of plan.labels (columns of labels holding 0 or 1), or None if the sample lacks the last label's 0 or 1.

    An earlier label that lacks one of them picks no features and gets about its base rate everywhere.

    Rows of labels with a null id or label are left out; of repeated ids one counts, the one with the
    greatest labels. Of repeated documents one text counts.
    """
    cols = list(plan.labels)
    clean = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int") for c in cols]).dropna()
    one = clean.groupBy("id").agg(*[F.max(c).alias(c) for c in cols])
    sample = one.orderBy(F.xxhash64("id"), "id").limit(plan.rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The sample has at most plan.rows rows of two numbers and the labels.
    rows = settle(texts.join(F.broadcast(sample), "id").groupBy("id", *cols).agg(F.max("text").alias("text")).select("text", *cols)).coalesce(8)

    seen = np.array(rows.agg(F.count("*"), *[F.coalesce(F.sum((F.col(c) != 0).cast("long")), F.lit(0)) for c in cols]).first(), dtype=np.float64)
    told = (seen[1:] > 0) & (seen[1:] < seen[0])
    if not told[-1]:
        return None

    def frequencies(batches):
        n = 1 << plan.bits
        total = np.zeros((len(cols) + 1, n), dtype=np.int32)  # texts with the feature: all, and those with each label
        for b in batches:
            y = np.array([[1] * b.num_rows] + [b.column(1 + k).to_pylist() for k in range(len(cols))], dtype=bool)
            for lo, hi, part in _prepared(b, 0, plan):
                of, value, _ = hashed(part, plan)
                pairs = np.unique(of.astype(np.int64) << plan.bits | value)
                of, value = pairs >> plan.bits, pairs & (n - 1)
                for k in range(len(cols) + 1):
                    total[k] += np.bincount(value[y[k, lo:hi][of]], minlength=n).astype(np.int32)
        firsts = range(0, n, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array([zlib.compress(total[:, a:a + BLOCK].tobytes(), 1) for a in firsts], pa.binary())], names=["first", "total"])

    def differences(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(t), dtype=np.int32).reshape(len(cols) + 1, -1) for t in group.column("total").to_pylist())
        z = np.zeros(total.shape[1])
        for k in np.flatnonzero(told):
            on, n1, n0 = total[k + 1], seen[k + 1], seen[0] - seen[k + 1]
            off, p = total[0] - on, total[0] / seen[0]
            z = np.maximum(z, np.abs(on / n1 - off / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1)))
        at = np.flatnonzero(z > 0)
        return pa.table({"value": group.column("first")[0].as_py() + at, "z": z[at]})

    ranked = rows.mapInArrow(frequencies, "first bigint, total binary").groupBy("first").applyInArrow(differences, "value bigint, z double")
    best = [r.value for r in ranked.orderBy(F.desc("z"), "value").limit(plan.features).collect()]  # at most plan.features numbers
    slot = np.zeros(1 << plan.bits, dtype=np.int32)
    slot[best] = np.arange(1, len(best) + 1)
    width = len(best) + 1
    shared = docs.sparkSession.sparkContext.broadcast(slot)

    def vectors(batches):
        for b in batches:
            for lo, hi, part in _prepared(b, 0, plan):
                of, value, totals = hashed(part, plan)
                s = shared.value[value]
                of, s, x = counted(of[s > 0], s[s > 0], totals, width, plan)
                cut = np.searchsorted(of, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(1 + k)[lo:hi] for k in range(len(cols))]
                    + [pa.array([s[i:j].astype("<i4").tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
                       pa.array([x[i:j].astype("<f4").tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], names=[*cols, "s", "x"])

    sparse = rows.mapInArrow(vectors, ", ".join(f"{c} int" for c in cols) + ", s binary, x binary").collect()
    sparse.sort(key=lambda r: (zlib.crc32(r.s), zlib.crc32(r.x), *(r[c] for c in cols)))  # folds and sums do not follow the order of arrival
    x = np.zeros((len(sparse), width - 1 + len(cols)), dtype=np.float32)  # the last columns are filled by the chain
    for i, r in enumerate(sparse):
        x[i, np.frombuffer(r.s, dtype="<i4") - 1] = np.frombuffer(r.x, dtype="<f4")
    y = np.array([[r[c] for c in cols] for r in sparse], dtype=np.float64)
    del sparse
    return Model(plan, slot, tuple(chained(x, y, plan)))


def fit_chain(x: np.ndarray, y: np.ndarray, plan: Plan):
    """A layer per column of y; each sees the out-of-fold probabilities of those before it."""
    return chained(np.concatenate([x, np.zeros(y.shape, dtype=np.float32)], axis=1), y, plan)


def chained(x: np.ndarray, y: np.ndarray, plan: Plan):
    """fit_chain with room in x for a column per column of y, which it fills."""
    fold = np.arange(len(x)) * 2654435761 % (1 << 32) * plan.folds >> 32
    use = np.column_stack([*(fold != f for f in range(plan.folds)), np.ones(len(x), dtype=bool)])
    width = x.shape[1] - y.shape[1]
    for k in range(y.shape[1]):
        t, seen = y[:, k], x[:, :width + k]
        w, bias = logistic(seen, t, use, plan)
        score = (seen @ w.astype(np.float32) + bias)[np.arange(len(x)), fold]
        a, b = platt(score, t)
        yield w[:, -1], float(bias[-1]), a, b
        x[:, width + k] = probability(score, a, b)


def predict(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probabilities, a row per text and a column per label."""
    plan, width = model.plan, len(model.layers[0][0]) + 1
    of, value, totals = hashed(texts, plan)
    s = model.slot[value]
    of, s, x = counted(of[s > 0], s[s > 0], totals, width, plan)
    out = np.zeros((len(texts), len(model.layers)))
    for k, (w, bias, a, b) in enumerate(model.layers):
        score = np.bincount(of, weights=x * w[s - 1], minlength=len(texts)) + bias + out[:, :k] @ w[width - 1:]
        out[:, k] = probability(score, a, b)
    return out


def predict_batch(model: Model, batch: pa.RecordBatch, at: int) -> np.ndarray:
    """Probabilities for every row of an Arrow batch, from whole texts."""
    parts = [predict(model, part) for _, _, part in _prepared(batch, at, model.plan)]
    return np.concatenate(parts) if parts else np.zeros((0, len(model.layers)))

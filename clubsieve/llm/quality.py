"""Quality rules: fixed base rules, then a calibrated n-gram logistic regression against fixed thresholds.

Base figures come from the words (longest runs without ASCII white space) of the whole text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import linear
from .words import text_bytes

LEAST_WORDS, MOST_REPEATED_PERCENT, LEAST_PROBABILITY = 50, 50, 0.5
PLAN = linear.Plan(labels=("quality",), grams=(3, 4), rate=True, lower=False)
_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_CONTINUED = bytes(range(0x80, 0xC0)) + b" \t\n\v\f\r"
_BLANK = b" \t\n\v\f\r"


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)]
    n = len(words)
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
        _, of, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        cover = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(count[of] > 1)
        cover[at] += 1
        cover[at + 3] -= 1
        repeated = int((np.cumsum(cover[:-1]) > 0).sum())
    return n, len(text.translate(None, _CONTINUED)), len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: linear.Plan = PLAN,
                  least_probability: float = LEAST_PROBABILITY) -> DataFrame:
    """id, base figures, base_failed, probability of good quality, and kept, for every row of docs.

    A null or empty text has no words and fails. Without labels of both kinds there is no model: probability
    is null and the base rules alone decide. Repeated rows are scored each. Other columns take no part.
    """
    model = linear.fit(docs, labels, plan, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits slots and `features` weights
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        m = shared.value
        for b in batches:
            figures = np.array([base_figures(t) for t in text_bytes(b.column(1))], dtype=np.int64).reshape(-1, 5)
            good = linear.predict_batch(m, b, 1)[:, 0] if m else None
            p = pa.array(good, pa.float64()) if m else pa.nulls(len(figures), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(figures[:, k]) for k in range(5)], p], names=["id", *names, "p_quality"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", p_quality double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed) \
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("p_quality") >= least_probability, F.lit(True)))

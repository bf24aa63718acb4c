"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of those before it.

The labels table says only whether a text is toxic. Two finer categories are therefore read off the toxic
rows by short seed lists; they are weak labels, and the last category is the given label itself.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import linear, words as W

# Seeds of the weak categories.
INSULT = ("idiot", "moron", "clown", "loser", "scum", "trash")
CONTEMPT = ("stupid", "worthless", "pathetic", "disgusting")
CATEGORIES = ("insult", "contempt", "toxic")
THRESHOLD = 0.5
PLAN = linear.Plan(labels=CATEGORIES, grams=(5, 6))


def weak_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """id, insult, contempt and toxic (0 or 1) of every labelled row; the first two only where toxic is 1."""
    toxic = labels.where(F.col(label) == 1).select(id_col).distinct()
    low = F.lower(F.col(text_col))
    marked = docs.select(id_col, *[low.rlike(r"\b(" + "|".join(seeds) + r")\b").cast("int").alias(n) for n, seeds in (("insult", INSULT), ("contempt", CONTEMPT))]) \
        .join(toxic, id_col, "left_semi").groupBy(id_col).agg(F.max("insult").alias("insult"), F.max("contempt").alias("contempt"))
    return labels.select(id_col, F.col(label).cast("int").alias("toxic")).join(marked, id_col, "left") \
        .select(id_col, F.coalesce("insult", F.lit(0)).alias("insult"), F.coalesce("contempt", F.lit(0)).alias("contempt"), "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: linear.Plan = PLAN,
                   threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, and p_<category> for each and the verdict is_toxic: the last probability reaches the threshold.

    labels holds the categories of plan.labels as 0 or 1. Null and empty texts have no feature and get the
    base rates, as does every text for an earlier category without both kinds of label. A last category
    without both leaves no model: probabilities are null and no row is toxic. Repeated rows are scored each. Columns of docs that bear an added name are replaced.
    """
    model = linear.fit(docs, labels, plan, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits slots and `features` weights
    added = [f"p_{c}" for c in plan.labels]
    names = [c for c in docs.columns if c not in (*added, "is_toxic")]
    at = names.index(text_col)
    schema = docs.select(*names).schema
    for c in added:
        schema = schema.add(c, "double")

    def run(batches):
        m = shared.value
        for b in W.parts(batches, at):
            p = linear.predict_batch(m, b, at) if m else None
            columns = [pa.array(p[:, k], pa.float64()) if m else pa.nulls(b.num_rows, pa.float64()) for k in range(len(added))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*names, *added])

    return docs.select(*names).mapInArrow(run, schema).withColumn("is_toxic", F.coalesce(F.col(added[-1]) >= threshold, F.lit(False)))

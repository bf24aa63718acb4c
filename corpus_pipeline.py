"""The corpus pipeline: toxicity, near copies, repeated passages, secrets, packing.

STAGES are applied to `documents` one after the other, each reading what the one before wrote. All but the
last return the columns of documents: texts shrink where passages or secrets go, and n_chars follows.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from clubsieve.llm import packing, secrets, simhash, substrings, toxicity
from clubsieve.session import shared_folder

#: No SQL can train a classifier or run a tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def _held(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text as one struct, so that none can clash with what an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("held"))


def _released(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of documents as they were. Another text brings its own length; null texts stay null."""
    if text == "text":
        return rows.select(*[F.col("text") if c == "text" else F.col(f"held.`{c}`").alias(c) for c in columns])
    new = F.when(F.col("text").isNotNull(), F.col(text))
    return rows.select(*[new.alias(c) if c == "text" else F.char_length(new).cast("long").alias(c) if c == "n_chars" else F.col(f"held.`{c}`").alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels, does not reject. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(_held(docs), toxicity.weak_labels(docs, labels))
    blank = F.col("text").isNull() | (F.col("text") == "")
    return _released(scored.where(~F.col("is_toxic") | blank), docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of repeated rows of it, one.

    Null and empty texts are near copies of each other. Rows without an id cannot be named and all stay.
    """
    named = docs.where("doc_id is not null")
    leaders = simhash.near_copies(named).groupBy("component").agg(F.count("*").alias("n")).select(F.col("component").alias("doc_id"))
    kept = _held(named).join(leaders, "doc_id", "left_semi")
    # Ids are unique in a well-formed table, so these groups hold one row.
    one = kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("n = 1")
    return _released(one, docs.columns).unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; texts that had none stay as they are."""
    found = substrings.without_repeated_windows(_held(docs))
    changed = found.withColumn("left", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return _released(changed, docs.columns, "left")


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of every secret."""
    return _released(secrets.scan(_held(docs)), docs.columns, "redacted")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids."""
    return packing.pack(docs).select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near_copies", one_of_near_copies), ("substrings", drop_repeated_passages), ("secrets", drop_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written below the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

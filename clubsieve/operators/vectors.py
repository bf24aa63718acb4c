"""Vector search and the preparation of text pieces for it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pages as page_rules, vectors
from .ranking import top_n


def similar(df: DataFrame, query: list[float], k: int = 10, threshold: float = 0.0, vector: str = "embedding") -> DataFrame:
    """The k rows most similar to one query vector, strictly above a threshold.

    The vector is a literal of the plan, so each task keeps its own k best rows.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("similarity", vectors.cosine(F.col(vector), q)).drop(vector)
    return scored.filter(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "vec_id").limit(k)


def similar_to_each(df: DataFrame, queries: dict[str, list[float]], k: int = 10, threshold: float = 0.0,
                    vector: str = "embedding") -> DataFrame:
    """The k best rows for each of a few query vectors, in one scan and without a join."""
    qs = F.array(*[F.struct(F.lit(n).alias("query"), F.array(*[F.lit(float(x)) for x in v]).alias("q")) for n, v in queries.items()])
    scored = (df.withColumn("one", F.explode(qs))
              .withColumn("similarity", vectors.cosine(F.col(vector), F.col("one.q")))
              .select("vec_id", F.col("one.query").alias("query"), "similarity").filter(F.col("similarity") > threshold))
    return top_n(scored, "query", [F.desc("similarity"), "vec_id"], k, "rank")


def page_pieces(pages: DataFrame, page_type: Column, metadata: Column, embedded: int | None = 8000) -> DataFrame:
    """Clean text of pages with the part that an embedding service takes, and tagged metadata.

    `embedded` is the longest input of the service in characters, None for whole texts. Where the
    rest shall get vectors too, cut `content` with `text_pieces`.
    """
    text = page_rules.html_to_text(F.col("html"))
    return pages.withColumn("content", text).select(
        "page_id", F.col("url").alias("url_scraped"), page_type.alias("page_type"), "content",
        (F.col("content") if embedded is None else F.left("content", F.lit(embedded))).alias("embed_text"),
        F.map_concat(metadata, F.create_map(F.lit("page_type"), page_type, F.lit("source_url"), F.col("url"))).alias("metadata"))


def text_pieces(docs: DataFrame, text: str, keep: list[str], longest: int = 1000) -> DataFrame:
    """Texts in even pieces of at most `longest` words (so above half of it for longer texts)."""
    words = F.split(text, r"\s+")
    n = F.greatest(F.lit(1), F.ceil(F.size("words") / longest)).cast("int")
    size = F.ceil(F.size("words") / F.col("n")).cast("int")
    return (docs.select(*keep, words.alias("words")).withColumn("n", n).withColumn("size", size)
            .select(*keep, "words", "size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"))
            .select(*keep, "piece", F.array_join(F.slice("words", F.col("piece") * F.col("size") + 1, F.col("size")), " ").alias("piece_text"))
            .filter("piece_text <> ''"))

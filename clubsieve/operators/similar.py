"""Joins by text similarity: exact filters in Spark, the matching-block ratio only on what they leave.

The ratio of two texts is twice the letters that lie in matching blocks over the letters of both. Blocks
keep order, so they never hold more letters than both texts have in common, whatever their order; that
bound is exact and comes from letter counts. Pairs are looked for through shared keys:

* Every two blocks lie at least one unmatched letter apart, so texts of L letters together with a ratio of
  at least r share L * (1.5 r - 1) - 1 pairs of neighbouring letters or more. Each text therefore only needs
  to be found under its rarest letter pairs, all but as many as it must share with any partner.
* Where that number is below one, for short texts or a low floor, single letters take the place of pairs.

Repeated letters and letter pairs are numbered, so that each occurrence is a key of its own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import ratio
from ..session import settle

#: Letters counted one by one; all others share one count.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
_SLACK = 1e-9  # bounds are compared with a floor in floating point


def letter_counts(text: Column) -> Column:
    """How often each letter of ALPHABET occurs, then all other letters together."""
    size = F.char_length(text)
    counts = [size - F.char_length(F.translate(text, c, "")) for c in ALPHABET]
    return F.array(*counts, F.char_length(F.translate(text, ALPHABET, "")))


def bound(size_a: Column, counts_a: Column, size_b: Column, counts_b: Column) -> Column:
    """No ratio of texts of these sizes and letter counts is greater; two empty texts are equal."""
    common = sum((F.least(counts_a[i], counts_b[i]) for i in range(1, len(ALPHABET) + 1)), F.least(counts_a[0], counts_b[0]))
    return F.when(size_a + size_b == 0, 1.0).otherwise(2.0 * common / (size_a + size_b))


def with_letters(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds what bound() needs as the columns <name>_size and <name>_counts."""
    return df.withColumns({f"{name}_size": F.char_length(text), f"{name}_counts": letter_counts(F.col(text))})


def may_reach(floor: float, a: str = "a", b: str = "b") -> Column:
    """Whether the texts with the letters of with_letters() can have a ratio of at least the floor."""
    return bound(F.col(f"{a}_size"), F.col(f"{a}_counts"), F.col(f"{b}_size"), F.col(f"{b}_counts")) >= floor - _SLACK


def ratios(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The ratio of every distinct pair of texts."""
    return pairs.select(a, b).distinct().withColumn("ratio", ratio(a, b))


def _numbered(keys: Column) -> Column:
    """Each key with its number among equal ones. Work grows with the square of the keys of one text."""
    ordered = F.array_sort(keys)
    return F.transform(ordered, lambda k, i: F.concat(k, F.lit("\u0001"), (i + 1 - F.array_position(ordered, k)).cast("string")))


def _least_partner(size: Column, floor: float) -> Column:
    """Letters of the text and its shortest possible partner together."""
    return size + F.ceil(size * (floor / (2 - floor)) - _SLACK)


def _keys(texts: DataFrame, floor: float) -> DataFrame:
    """(text, keys): letter pairs and letters with the number that any partner must share of each."""
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    size = F.char_length("text")
    both = _least_partner(size, floor)
    shared_pairs = F.ceil(both * (1.5 * floor - 1) - 1 - _SLACK)
    # A text meets the short ones, which pairs cannot find, if it is no longer than their longest partner.
    short = F.lit(True) if floor <= 2 / 3 else (F.ceil(_least_partner(F.floor(size * (floor / (2 - floor)) + _SLACK), floor) * (1.5 * floor - 1) - 1 - _SLACK) < 1)
    pairs = F.when(F.size("letters") > 1, F.transform(F.sequence(F.lit(0), F.size("letters") - 2), lambda i: F.concat(F.col("letters")[i], F.col("letters")[i + 1]))).otherwise(F.array().cast("array<string>"))
    sets = texts.withColumn("letters", letters).select(
        "text", F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.when(shared_pairs >= 1, _numbered(pairs)).alias("keys"), shared_pairs.alias("need")),
                                  F.struct(F.lit("l").alias("kind"), F.when(short, _numbered(F.col("letters"))).alias("keys"), F.ceil(both * (floor / 2) - _SLACK).alias("need")))).alias("s"))
    return sets.select("text", "s.*").where("keys is not null and size(keys) >= need")


def _found_under(texts: DataFrame, frequency: DataFrame, floor: float) -> DataFrame:
    """(text, kind, key) for the keys that a text must be found under: all but need - 1 of them, the rarest first."""
    spread = _keys(texts, floor).select("text", "kind", "need", F.explode("keys").alias("key")).join(frequency, ["kind", "key"])
    ranked = spread.groupBy("text", "kind", "need").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("ranked"))
    return ranked.select("text", "kind", F.explode(F.slice("ranked", F.lit(1), F.size("ranked") - F.col("need").cast("int") + 1)).alias("r")).select("text", "kind", "r.key")


def candidates(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Distinct pairs (a, b) of the texts of two one-column frames that no filter rules out; equal texts are left out."""
    sides = [df.toDF("text").where("text is not null").distinct() for df in (left, right)]
    every = sides[0].unionByName(sides[1]).distinct()
    frequency = _keys(every, floor).select("kind", F.explode("keys").alias("key")).groupBy("kind", "key").agg(F.count("*").alias("n"))
    a, b = (_found_under(s, frequency, floor).withColumnRenamed("text", name) for s, name in zip(sides, "ab"))
    # Settled, as the optimizer would move the filter ahead of the aggregate.
    pairs = settle(a.join(b, ["kind", "key"]).select("a", "b").where("a <> b").distinct())
    return with_letters(with_letters(pairs, "a", "a"), "b", "b").where(may_reach(floor)).select("a", "b")


def similar_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(a, b, ratio) of all distinct texts of two one-column frames with a ratio of at least `floor`, which is above zero.

    Nulls take no part, copies count once, two empty texts are equal. No pair is lost to a filter. A letter
    pair that many texts share is a key of few, as each text is found under its rarest ones.
    """
    sides = [df.toDF(name).where(F.col(name).isNotNull()).distinct() for df, name in ((left, "a"), (right, "b"))]
    equal = sides[0].join(sides[1], F.col("a") == F.col("b")).withColumn("ratio", F.lit(1.0))
    return ratios(candidates(left, right, floor)).where(F.col("ratio") >= floor).unionByName(equal)

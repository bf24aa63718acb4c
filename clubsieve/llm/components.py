"""Connected components of a table of links, by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle


def components(links: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """node, component for every node of links(a, b); component is the smallest node reachable.

    Each round points every node at its smallest neighbour if that is smaller, follows pointers to their end,
    and replaces links by links between those ends; a component has at most half the nodes left. A node that points at none keeps its name,
    so what is left of a component in the end bears its smallest node's. Links shrink from round to round,
    nodes that one has lost meet no later one again; tables lie in checkpoints. Raises after most_rounds.
    """
    edges = settle(links.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct())
    names = None
    for _ in range(most_rounds):
        ends = edges.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*")
        first = settle(ends.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("up")))
        if first.isEmpty():
            break
        to = first
        while True:  # each step doubles how far a pointer reaches; the last one changes nothing
            top = to.select(F.col("node").alias("n"), F.col("up").alias("upper")).hint("merge")
            step = settle(to.join(top, to.up == top.n).select("node", F.col("upper").alias("up"), (F.col("up") != F.col("upper")).alias("moved")))
            to = step.select("node", "up")
            if step.where("moved").isEmpty():
                break
        to = to.select("node", F.col("up").alias("name"))
        if names is None:
            names = to
        else:
            newer = to.select(F.col("node").alias("n"), F.col("name").alias("newer")).hint("merge")
            names = settle(names.join(newer, names.name == newer.n, "left").select("node", F.coalesce("newer", "name").alias("name")))
        left = to.select(F.col("node").alias("x"), F.col("name").alias("a")).hint("merge")
        right = to.select(F.col("node").alias("y"), F.col("name").alias("b")).hint("merge")
        edges = settle(edges.join(left, "x").join(right, "y").where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    else:
        raise RuntimeError(f"components are not whole after {most_rounds} rounds")
    if names is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return names.select("node", F.col("name").alias("component"))

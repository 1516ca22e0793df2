"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): one row per linked node; label is the least node of some kind, the same in a component.

    Nodes are of any type with an order, random as that of hashes. In each round every node moves
    to its least neighbour, links are rewritten between the new names, and those
    within one name go; in random order the longest path shrinks to a share of its
    length, so rounds grow as the logarithm of the links. Each round is a table in
    the shared folder; a node with very many links is only ever summed or joined.
    """
    links = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        moves = kept(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")), "moves")
        if labels is None:
            labels = moves.withColumnRenamed("to", "label")
        else:
            labels = kept(labels.join(moves.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a, b = moves.select(F.col("node").alias("a"), F.col("to").alias("x")), moves.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(a, "a").join(b, "b").where("x <> y")
        links = kept(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels

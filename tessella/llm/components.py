"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node it is connected to.

    Each round links every node to the smallest of its neighbours and of itself, first from larger
    to smaller nodes and then among the smaller ones, so paths halve and the edges become stars.
    A node's neighbours are only aggregated (min) or joined, never gathered. Each round is a table in
    the checkpoint folder; the loop ends when a round changes nothing.
    """
    current = cut_lineage(_distinct(edges.select("a", "b")))
    before = None
    while True:
        linked = _small_star(_large_star(current))
        linked = cut_lineage(linked)
        state = linked.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        current, before = linked, state
    roots = current.groupBy("a").agg(F.min("b").alias("root"))
    return roots.withColumnRenamed("a", "node").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    """Every edge once, from its larger to its smaller end."""
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = both.filter(F.col("b") > F.col("a"))
    return _distinct(larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(linked.unionByName(least.select("a", F.col("m").alias("b"))))

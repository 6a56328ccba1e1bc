"""Connected components by alternating large-star and small-star steps.

Every step is a minimum by node, combined before the shuffle, that is joined back to the edge list; a node
with very many neighbours is so one skewed join key, which adaptive execution splits, and its neighbours are
never in one task. The edge list is written to the shared folder after each round; rounds go on until it
settles, after about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.shared import drop_table, materialise


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): ``edges`` with the least v of each u, or u itself where that is less."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    ranked = _least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return ranked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(ranked.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) but the roots; the root is the least node."""
    edges, state = materialise(edges.toDF("u", "v").filter("u != v"), "edges"), None
    while True:
        before, edges = edges, materialise(_small(_large(edges)), "edges")
        drop_table(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now

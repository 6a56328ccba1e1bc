"""Ranked lists: reciprocal-rank fusion, merging of partial results, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONSTANT = 60


def ranked(hits: DataFrame, name: str, *order) -> DataFrame:
    """Position from 1. ``hits`` is a top-k list, so one partition holds it."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank(vectors: DataFrame, texts: DataFrame, vector_weight: float, text_weight: float, limit: int, constant: int = CONSTANT) -> DataFrame:
    """(id, score, vector_rank, text_rank) of two lists (id, vector_rank) and (id, text_rank)."""
    part = lambda w, c: F.coalesce(F.lit(float(w)) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    both = vectors.select("id", "vector_rank").join(texts.select("id", "text_rank"), "id", "full_outer")
    fused = both.select("id", (part(vector_weight, "vector_rank") + part(text_weight, "text_rank")).alias("score"), "vector_rank", "text_rank")
    return fused.orderBy(F.desc("score"), "id").limit(limit)


def merge_single(parts: DataFrame, limit: int) -> DataFrame:
    """Hits (id, score) of several groups: the best score of each id, best first."""
    best = parts.groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(limit)


def merge_hybrid(vectors: DataFrame, texts: DataFrame, vector_weight: float, text_weight: float, limit: int) -> DataFrame:
    """Both sides of several groups (id, score): deduplicated, ranked over all and fused."""
    v, t = (p.groupBy("id").agg(F.max("score").alias("score")) for p in (vectors, texts))
    return reciprocal_rank(ranked(v, "vector_rank", F.desc("score"), "id"), ranked(t, "text_rank", F.desc("score"), "id"), vector_weight, text_weight, limit)


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row (recall): mean share of ``truth`` (query, id) that ``found`` (query, id) has."""
    hit = truth.join(found.select("query", "id").withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return hit.groupBy("query").agg((F.count("hit") / F.lit(k)).alias("r")).agg(F.avg("r").alias("recall"))

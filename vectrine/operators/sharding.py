"""Placement of documents on virtual shards and data groups, and scatter/gather over them."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.functions.text import stable_index_of
from vectrine.operators import bm25
from vectrine.operators.fusion import merge_hybrid, merge_single, ranked
from vectrine.schema import check

SHARDS = 1024
STATES = ("active", "copying", "catching_up", "switching", "draining")


def stable_shard(collection: UUID, id_: Column, count: int = SHARDS) -> Column:
    """SHA-256 of the collection's 16 bytes (first three fields little-endian) and the id's text."""
    head = F.lit(bytearray(collection.bytes_le))
    return stable_index_of(F.concat(head, F.encode(id_, "UTF-8")), count)


def initial_placement(spark: SparkSession, collection: UUID, groups: list[str], count: int = SHARDS) -> DataFrame:
    """(shard_id, data_group, target_group, state): groups go round from an offset that the collection's id gives."""
    check(count >= 1 and bool(groups), "invalid_placement")
    names = sorted(set(groups))
    offset = spark.range(1).select(stable_shard(collection, F.lit(collection.hex), len(names)).alias("o")).first().o
    order = F.array(*[F.lit(g) for g in names])
    return spark.range(count).select(F.col("id").cast("int").alias("shard_id"), F.element_at(order, (F.pmod(F.col("id") + offset, F.lit(len(names))) + 1).cast("int")).alias("data_group"), F.lit(None).cast("string").alias("target_group"), F.lit("active").alias("state"))


def route(docs: DataFrame, collection: UUID, placement: DataFrame, count: int = SHARDS) -> DataFrame:
    """``docs`` with shard_id and data_group. A shard that switches or drains is served by its target.
    The placement has ``count`` rows whatever the data, hence the broadcast."""
    serving = placement.select("shard_id", F.when(F.col("state").isin("switching", "draining"), F.coalesce("target_group", "data_group")).otherwise(F.col("data_group")).alias("data_group"))
    return docs.withColumn("shard_id", stable_shard(collection, F.col("id"), count)).join(F.broadcast(serving), "shard_id")


def sharded_vector_topk(docs: DataFrame, vector, k: int, metric: str = "cosine") -> DataFrame:
    """(id, score): top k of every data group, merged; the same as one global top k."""
    from vectrine.functions.distance import distance
    from vectrine.functions.distance import vector as literal

    d = docs.filter("vector is not null").select("id", "data_group", (-distance(F.col("vector"), literal(vector), metric)).alias("score"))
    line = Window.partitionBy("data_group").orderBy(F.desc("score"), "id")
    return merge_single(d.withColumn("rn", F.row_number().over(line)).filter(F.col("rn") <= k).select("id", "score"), k)


def gathered_statistics(docs: DataFrame, query: str) -> bm25.Statistics:
    """Statistics of each data group added up; equal to those of the whole."""
    terms = bm25.query_terms(query)
    rows = bm25.with_terms(docs, terms).groupBy("data_group").agg(F.count("*").alias("n"), F.sum("length").alias("t"), *[F.count_if(F.col("tf")[i] > 0).alias(f"d{i}") for i in range(len(terms))])
    total = bm25.Statistics(0, 0, {t: 0 for t in terms})
    for r in rows.collect():  # one row a data group
        total = total + bm25.Statistics(r.n, r.t, {t: r[f"d{i}"] for i, t in enumerate(terms)})
    return total


def sharded_text_topk(docs: DataFrame, query: str, k: int) -> DataFrame:
    """(id, score): each group ranks by the gathered statistics, and the lists are merged."""
    terms, stats = bm25.query_terms(query), gathered_statistics(docs, query)
    hits = bm25.with_terms(docs, terms).filter(F.exists("tf", lambda x: x > 0)).select("id", "data_group", bm25.score(terms, stats).alias("score"))
    line = Window.partitionBy("data_group").orderBy(F.desc("score"), "id")
    return merge_single(hits.withColumn("rn", F.row_number().over(line)).filter(F.col("rn") <= k).select("id", "score"), k)


def sharded_hybrid_topk(docs: DataFrame, vector, query: str, k: int, multiplier: int = 4, weights=(0.5, 0.5), texts: DataFrame | None = None) -> DataFrame:
    """(id, score, vector_rank, text_rank), by the single-node rule: both lists are cut to k * multiplier before fusion.
    ``texts`` (id, text, data_group) is where the texts are, if ``docs`` is a join that would have to move them."""
    c = max(k, k * multiplier)
    return merge_hybrid(sharded_vector_topk(docs, vector, c), sharded_text_topk(docs if texts is None else texts, query, c), *weights, k)


def replica_order(replicas: DataFrame, stale: bool) -> DataFrame:
    """Replicas (node, healthy, lag) in the order in which a read tries them."""
    order = [F.desc("healthy"), "lag", "node"] if stale else ["node"]
    return ranked(replicas, "choice", *order)


def shard_delta(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(id, kind): what turns a shard's snapshot (id, version, ...) into its current rows."""
    digest = lambda df, n: df.select("id", F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != "id"])), 256).alias(n))
    both = digest(snapshot, "before").join(digest(current, "after"), "id", "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select("id", F.when(F.col("after").isNull(), "delete").otherwise("upsert").alias("kind"))

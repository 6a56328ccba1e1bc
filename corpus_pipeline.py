"""A training corpus from the table of documents, in five stages.

Each stage takes what its predecessor kept, and all but the last return the columns of documents.
A stage's result is written as Parquet to the shared folder before the next one reads it.

Defined cases are those of the operators: rows with a null, empty or letterless text leave with the first stage, as no
language can be told; where the labels of two languages are lacking, all texts with a letter stay. Rows with a null id
can't be deduplicated or found to hold a benchmark item, stay until the mix and leave there, as they can't be drawn. Of
rows that repeat an id one stays. Texts are whole, extra columns are carried along, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectrine.llm import cube, decontam, golay_dedup, langid, sharding
from vectrine.llm.shared import drop_table, materialise, only_results, prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null, empty and letterless texts go, null ids stay."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of each id; null ids and texts without a word all stay."""
    return golay_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; an empty benchmark, null ids and null texts match nothing."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample with half the tokens, mixed by the square root of each source's size; null is a source like any
    other, null ids are never drawn."""
    return cube.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, by id; a null id goes to shard 0."""
    return sharding.shard(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", shards)]

#: Linear machines, Golay keys, alignment and random flights are beyond SQL; tests/llm compares to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with only_results(spark) as results:
            before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
            results.append(docs)
        if k:
            drop_table(before)
    return docs

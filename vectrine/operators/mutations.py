"""Mutations: add, upsert, update, delete, folded in order for each id, atomic or not.

A batch is a DataFrame (seq, kind, id, text, vector, metadata) where null fields of an update keep
the stored value. Ids fold side by side, each a stream in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.schema import DOCUMENT, check

KINDS = ("add", "upsert", "update", "delete")
RESULT = T.StructType().add("seq", T.LongType()).add("id", T.StringType()).add("succeeded", T.BooleanType()).add("error_code", T.StringType()).add("version", T.LongType())
OPERATION = T.StructType().add("seq", T.LongType()).add("op", T.StringType()).add("id", T.StringType()).add("version", T.LongType())
MAXIMUM_BATCH = 1000


def check_size(batch: DataFrame, maximum: int = MAXIMUM_BATCH) -> None:
    n = batch.limit(maximum + 1).count()
    check(1 <= n <= maximum, "invalid_batch_size", str(n))


def fold(current: DataFrame, batch: DataFrame, atomic: bool = True, maximum: int | None = None, invalid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results by mutation, changed rows): rows to store are (op, id, text, vector, metadata, version).

    A mutation whose ``seq`` is in ``invalid`` (seq, error_code) fails with that code, and it alone; where several
    fail, the first by ``seq`` is an atomic batch's error. A null id fails as ``invalid_document_id``.
    Only versions and null flags of a row are folded in Python; texts, vectors and metadata stay in
    the JVM, where the last write of each field is taken."""
    if maximum is not None:
        check_size(batch, maximum)
    whole = batch
    bad_id = F.when(F.col("id").isNull() | (F.trim("id") == "") | (F.length("id") > 512), "invalid_document_id")
    wrong = batch.select("seq", "id", bad_id.alias("error_code"))
    if invalid is not None:
        wrong = wrong.join(invalid.select("seq", F.col("error_code").alias("found")), "seq", "left").select("seq", "id", F.coalesce("error_code", "found").alias("error_code"))
    wrong = wrong.filter("error_code is not null")
    batch = batch.join(wrong.select("seq"), "seq", "left_anti")
    stored = current.select("id", F.col("version").alias("stored_version"))
    slim = batch.select("seq", "kind", "id", F.col("text").isNull().alias("no_text"), F.col("vector").isNull().alias("no_vector"), F.col("metadata").isNull().alias("no_metadata")).join(stored, "id", "left")
    schema = T.StructType(list(RESULT.fields)).add("op", T.StringType()).add("base", T.LongType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, version, base = None, None, -1
        for pdf in batches:
            rows = []
            columns = (pdf[c].tolist() for c in ("seq", "kind", "id", "no_text", "no_vector", "no_metadata", "stored_version"))
            for seq, kind, id_, no_text, no_vector, no_metadata, stored_version in zip(*columns):
                if id_ != now:
                    now, version = id_, None if pd.isna(stored_version) else int(stored_version)
                    base = -1 if version is None else 0
                code = None
                if kind == "add" and version is not None:
                    code = "document_already_exists"
                elif kind in ("update", "delete") and version is None:
                    code = "document_not_found"
                elif kind == "update" and no_text and no_vector and no_metadata:
                    code = "empty_update"
                if code:
                    rows.append((seq, id_, False, code, None, None, base))
                    continue
                new = (version or 0) + 1
                if kind != "update":
                    base = seq if kind != "delete" else -1
                version = None if kind == "delete" else new
                rows.append((seq, id_, True, None, new, "delete" if kind == "delete" else "upsert", base))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields]).astype({"version": "Int64", "base": "Int64"})

    # Sorted and streamed, so that an id with very many mutations is never held as a group.
    folded = slim.repartition("id").sortWithinPartitions("id", "seq").mapInPandas(run, schema)
    none = lambda t: F.lit(None).cast(t)
    folded = folded.union(wrong.select("seq", "id", F.lit(False), "error_code", none("bigint"), none("string"), none("bigint")))
    if atomic:
        # One row decides for all: the first error, if there is any.
        verdict = folded.filter(~F.col("succeeded")).agg(F.min(F.struct("seq", "error_code")).alias("first"))
        folded = folded.crossJoin(F.broadcast(verdict)).select("seq", "id", (F.col("succeeded") & F.col("first").isNull()).alias("succeeded"), F.coalesce("first.error_code", "error_code").alias("error_code"), F.when(F.col("first").isNull(), F.col("version")).alias("version"), "op", "base")
    results = folded.select("seq", "id", "succeeded", "error_code", "version")
    good = folded.filter("succeeded")
    last = good.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).filter("rn = 1").select("id", F.col("op"), F.col("version"), F.col("base"))
    # A field's value is that of the last write since the row was last replaced, else the stored one.
    writes = whole.join(good.select("seq"), "seq", "left_semi").join(last.select("id", "base"), "id").filter((F.col("seq") >= F.col("base")) & (F.col("kind") != "delete"))
    latest = writes.groupBy("id").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.to_json(F.struct(F.col(c).alias("v"))).alias("j"))) if c == "metadata" else F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v")))).alias(c) for c in ("text", "vector", "metadata")])
    meta_type = DOCUMENT["metadata"].dataType
    wrapped = T.StructType().add("v", meta_type)
    new = latest.select("id", F.col("text.v").alias("new_text"), F.col("vector.v").alias("new_vector"), F.from_json(F.col("metadata.j"), wrapped)["v"].alias("new_metadata"))
    old = current.select("id", *[F.col(c).alias(f"old_{c}") for c in ("text", "vector", "metadata")])
    rows = last.join(new, "id", "left").join(old, "id", "left")
    value = lambda c: F.when(F.col("op") == "upsert", F.coalesce(F.col(f"new_{c}"), F.when(F.col("base") == 0, F.col(f"old_{c}")))).alias(c)
    return results, rows.select("op", "id", value("text"), value("vector"), value("metadata"), "version")


def apply_by_version(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows after ``incoming`` (op, id, ..., version) in any order and repeated: a higher version wins,
    and a delete of version 0 always does."""
    columns = [c for c in current.columns if c != "op"]
    rank = lambda c: F.when((F.col("op") == "delete") & (F.col("version") == 0), F.lit((1 << 63) - 1)).otherwise(F.col(c))
    both = current.withColumn("op", F.lit("upsert")).withColumn("kept", F.lit(1)).unionByName(incoming.select(*[F.col(c) if c in incoming.columns else F.lit(None).alias(c) for c in columns], "op").withColumn("kept", F.lit(0)))
    line = Window.partitionBy("id").orderBy(rank("version").desc(), F.desc("kept"), F.asc("op"))
    return both.withColumn("rn", F.row_number().over(line)).filter("rn = 1 and op <> 'delete'").select(*columns)


def latest(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key of a change log, without keys that it deletes."""
    line = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("rn", F.row_number().over(line)).filter((F.col("rn") == 1) & (F.col("op") != "delete")).drop("rn")


def estimate_bytes(batch: DataFrame, collection: str) -> DataFrame:
    """One row (bytes): what a batch takes in a write queue."""
    row = F.lit(48) + F.length("id") * 2 + F.coalesce(F.length("text") * 2, F.lit(0)) + F.coalesce(F.when(F.col("vector").isNotNull(), F.size("vector") * 4), F.lit(0)) + F.coalesce(F.when(F.col("metadata").isNotNull(), F.size("metadata") * 64), F.lit(0))
    return batch.agg((F.lit(128 + 2 * len(collection)) + F.coalesce(F.sum(row), F.lit(0))).cast("bigint").alias("bytes"))

"""BM25 over a collection, by scan or by a postings table.

Statistics (documents, terms, document frequencies) are of the whole collection; a filter only
restricts which documents are scored. A scan counts tokens and terms of a document in one pass over its text and
needs no shuffle but that of one row of partial sums a task; an index is one row a (term, document), laid out by
term so that a query reads only the row groups of its terms, and is kept up to date by parts.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.functions.text import term_counts, token_blocks
from vectrine.operators.store import Store
from vectrine.schema import check

K1, B = 1.2, 0.75
MAXIMUM_TERMS = 100_000


@dataclass(frozen=True)
class Statistics:
    documents: int
    terms: int
    frequency: dict[str, int]

    def __add__(self, other: "Statistics") -> "Statistics":
        """Statistics of two disjoint groups of documents together."""
        names = {*self.frequency, *other.frequency}
        return Statistics(self.documents + other.documents, self.terms + other.terms, {t: self.frequency.get(t, 0) + other.frequency.get(t, 0) for t in names})


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, in order, by the rule of :func:`tokenize`; no job."""
    plain = "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in query.lower())
    return list(dict.fromkeys(plain.split()))


def with_terms(docs: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """Adds ``length`` (tokens) and ``tf`` (array: count of each of ``terms``)."""

    @F.arrow_udf("struct<length:int,tf:array<int>>")
    def counted(texts: pa.Array) -> pa.Array:
        length, counts = term_counts(texts, terms)
        tf = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(terms)), pa.array(counts.ravel()))
        return pa.StructArray.from_arrays([pa.array(length), tf], ["length", "tf"])

    # What is not deterministic is not copied into the filters above it, so texts are read once.
    return docs.withColumn("__counted", counted.asNondeterministic()(F.col(text_col))).withColumns({"length": F.col("__counted.length"), "tf": F.col("__counted.tf")}).drop("__counted")


def statistics(docs: DataFrame, query: str, text_col: str = "text") -> Statistics:
    terms = query_terms(query)
    rows = with_terms(docs, terms, text_col)
    sums = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms"), *sums).first()
    return Statistics(r.n, r.terms, {t: r[f"df{i}"] for i, t in enumerate(terms)})


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def score(terms: list[str], stats: Statistics, k1: float = K1, b: float = B, tf: str = "tf", length: str = "length") -> Column:
    """Score from ``tf`` and ``length``; a document without any term scores 0."""
    average = max(stats.terms / max(stats.documents, 1), 1.0)
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        f = F.col(tf)[i].cast("double")
        total = total + F.when(f > 0, F.lit(idf(stats.documents, stats.frequency.get(t, 0))) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col(length) / average))).otherwise(F.lit(0.0))
    return total


def search(docs: DataFrame, query: str, limit: int, candidates: Column | DataFrame | None = None, stats: Statistics | None = None, k1: float = K1, b: float = B, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score): the best ``limit`` documents that hold a term, ties by id. ``candidates`` is a condition, or a table of ids
    that are joined with scores, so that texts are not moved."""
    terms = query_terms(query)
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    stats = stats or statistics(docs, query, text_col)
    rows = docs.filter(candidates) if isinstance(candidates, Column) else docs
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = with_terms(rows, terms).filter(F.exists("tf", lambda x: x > 0)).select("id", score(terms, stats, k1, b).alias("score"))
    if isinstance(candidates, DataFrame):
        hits = hits.join(candidates.select("id"), "id", "left_semi")
    return hits.orderBy(F.desc("score"), "id").limit(limit)


def too_long(docs: DataFrame, maximum: int = MAXIMUM_TERMS, text_col: str = "text") -> DataFrame:
    """Documents of more than ``maximum`` tokens, which are rejected, not cut. Shorter texts than that aren't looked at."""
    return with_terms(docs.filter(F.length(text_col) > maximum), [], text_col).filter(F.col("length") > maximum).drop("length", "tf")


# Postings


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, length) of every distinct token of every document; no shuffle."""

    def each(batches):
        for batch in batches:
            ids = batch.column(0)
            for b in token_blocks(batch.column(1)):
                if not len(b.start):
                    continue
                words = pa.array([b.lower[x:y] for x, y in zip(b.start.tolist(), b.end.tolist())]).dictionary_encode()
                doc = np.searchsorted(b.at, np.arange(len(words)), "right") - 1
                wide = len(words.dictionary)
                key, tf = np.unique(doc * wide + words.indices.to_numpy(), return_counts=True)
                doc = key // wide
                length = np.diff(b.at)[doc].astype(np.int32)
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(key % wide)), ids.take(pa.array(b.first + doc)), pa.array(tf.astype(np.int64)), pa.array(length)], ["term", "id", "tf", "length"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType().add("term", T.StringType()).add("id", rows.schema["id"].dataType).add("tf", T.LongType()).add("length", T.IntegerType())
    return rows.mapInArrow(each, schema)


class PostingsIndex:
    """Postings on disk in parts. A part has ``postings`` sorted by term, ``lengths`` (id, length) of its documents, and
    ``touched``, the ids that it replaces or removes in the parts before it. The totals and the parts' names are in
    numbered manifests, so that a writer that fails, or comes second, changes nothing.

    An update costs what it touches; a search reads the row groups of its terms in each part, without ids that a later
    part touches. :meth:`compact` makes one part of all."""

    COMPACT_AT = 16

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Store(spark, path)
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> "PostingsIndex":
        """Over a new or empty folder."""
        index = PostingsIndex(docs.sparkSession, path)
        index.store.commit("manifests", 0, {"parts": [], "documents": 0, "terms": 0})
        index.apply(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        return index

    def _manifest(self) -> tuple[int, dict]:
        found = self.store.latest("manifests")
        check(found is not None, "index_not_found", self.path)
        return found

    @property
    def documents(self) -> int:
        return self._manifest()[1]["documents"]

    @property
    def terms(self) -> int:
        return self._manifest()[1]["terms"]

    def _live(self, manifest: dict, name: str) -> DataFrame | None:
        """Rows of ``name`` of all parts, without ids that a later part touches."""
        out = None
        for i, part in enumerate(manifest["parts"]):
            rows = self.spark.read.parquet(f"{self.path}/{part}/{name}")
            later = [f"{self.path}/{p}/touched" for p in manifest["parts"][i + 1 :]]
            if later:
                rows = rows.join(self.spark.read.parquet(*later), "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def apply(self, upserts: DataFrame, removed: DataFrame | None = None) -> None:
        """Index ``upserts`` (id, text) in place of what their ids had, and forget ``removed`` (id). Nothing is
        changed if a text is too large."""
        check(too_long(upserts).isEmpty(), "text_too_large")
        number, m = self._manifest()
        part = f"part-{uuid.uuid4().hex[:12]}"
        at = lambda name: f"{self.path}/{part}/{name}"
        with_terms(upserts, []).select("id", "length").write.parquet(at("lengths"))
        lengths = self.spark.read.parquet(at("lengths"))
        touched = lengths.select("id")
        (touched if removed is None else touched.union(removed.select("id")).distinct()).write.parquet(at("touched"))
        touched = self.spark.read.parquet(at("touched"))
        # a range's bounds are found by a pass of its own, for which texts aren't read again
        rows = postings(upserts).persist(StorageLevel.DISK_ONLY)
        rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(at("postings"))
        rows.unpersist()
        sums = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())
        before = self._live(m, "lengths")
        gone = sums(before.join(touched, "id", "left_semi")) if before is not None else (0, 0)
        new = sums(lengths)
        self.store.commit("manifests", number, {"parts": [*m["parts"], part], "documents": m["documents"] - gone[0] + new[0], "terms": m["terms"] - gone[1] + new[1]})
        if len(m["parts"]) + 1 >= self.COMPACT_AT:
            self.compact()

    def compact(self) -> None:
        number, m = self._manifest()
        part = f"part-{uuid.uuid4().hex[:12]}"
        self._live(m, "postings").repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{self.path}/{part}/postings")
        self._live(m, "lengths").write.parquet(f"{self.path}/{part}/lengths")
        self.spark.read.parquet(f"{self.path}/{part}/lengths").select("id").write.parquet(f"{self.path}/{part}/touched")
        self.store.commit("manifests", number, m | {"parts": [part]})
        self.store.prune("manifests")

    def search(self, query: str, limit: int, k1: float = K1, b: float = B, candidates: DataFrame | None = None) -> DataFrame:
        """(id, score), ties by id; frequencies are of all documents, scores of ``candidates`` (id) only."""
        _, m = self._manifest()
        rows, terms = self._live(m, "postings"), query_terms(query)
        hits = rows.filter(F.col("term").isin(terms)) if terms else rows.limit(0)
        n, average = m["documents"], max(m["terms"] / max(m["documents"], 1), 1.0)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        if candidates is not None:
            hits = hits.join(candidates.select("id"), "id", "left_semi")
        one = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
        # one row a term of the query
        return hits.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(one).alias("score")).orderBy(F.desc("score"), "id").limit(limit)

"""Document fingerprints: SimHash, and all pairs of fingerprints within a Hamming radius.

Distinct words of a text vote on 64 signed bits with weight 1 + floor(log2(count)).
For radius k the 64 bits are cut into b > k blocks. For every choice of b - k blocks there
is a permuted table keyed by those blocks: k wrong bits spoil at most k blocks, so that
every pair within the radius meets in some table. A pair is reported by the first table
only, hence no distinct over pairs is needed.

Defined cases: null ids and texts without a letter or digit (null, empty) get no fingerprint;
repeated rows count once; equal fingerprints are reported as a star around the least id, so a
group of n copies gives n - 1 rows; other columns of the input are ignored; an empty table
gives an empty result; ids are numbers or cast to them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.kernel import Words, blocks, simhash_bits, text_array
from vectrine.llm.shared import materialise, own, prepare

PAIRS = "doc_a bigint, doc_b bigint, distance int, fp_a bigint, fp_b bigint"


def block_masks(radius: int, blocks_: int, bits: int = 64) -> list[int]:
    """Signed 64-bit mask of each permuted table's key."""
    if not 0 <= radius < blocks_ <= bits:
        raise ValueError("need 0 <= radius < blocks <= 64")
    edges = [round(i * bits / blocks_) for i in range(blocks_ + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks_ - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row that has an id and a word."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            text = text_array(batch.column(1))
            for i, j in blocks(text):
                w = Words(text.slice(i, j - i))
                some = np.flatnonzero(np.diff(w.first))
                fp = np.packbits(simhash_bits(w, (0,)), axis=1, bitorder="little").view(np.int64)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(fp[some])], ["doc_id", "fp"])

    rows = own(docs, id=id_col, text=text_col).filter("id is not null and text is not null")
    return rows.select(F.col("id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def near_fingerprints(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs of ``fps`` (doc_id, fp) within ``radius``, as PAIRS; doc_a and doc_b stand for all
    documents of their fingerprint, which are linked to them by rows of distance 0."""
    one = fps.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    same = (
        fps.join(one, "fp").filter(F.col("doc_id") != F.col("doc")).select(F.col("doc").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(0).alias("distance"), F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b")).distinct()
    )
    if not radius:
        return same
    masks = block_masks(radius, blocks)
    tables = F.array(*[F.struct(F.lit(t).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    keyed = one.select("doc", "fp", F.explode(tables).alias("x")).select("doc", "fp", "x.t", "x.key")
    a, b = keyed.select(*[F.col(c).alias(f"{c}_a") for c in keyed.columns]), keyed.select(*[F.col(c).alias(f"{c}_b") for c in keyed.columns])
    differ = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    pairs = a.join(b, (F.col("t_a") == F.col("t_b")) & (F.col("key_a") == F.col("key_b")) & (F.col("fp_a") < F.col("fp_b")) & (F.bit_count(differ) <= radius) & (first == F.col("t_a")))
    swap = F.col("doc_a") > F.col("doc_b")
    pairs = pairs.select(
        F.when(swap, F.col("doc_b")).otherwise(F.col("doc_a")).alias("doc_a"), F.when(swap, F.col("doc_a")).otherwise(F.col("doc_b")).alias("doc_b"), F.bit_count(differ).cast("int").alias("distance"),
        F.when(swap, F.col("fp_b")).otherwise(F.col("fp_a")).alias("fp_a"), F.when(swap, F.col("fp_a")).otherwise(F.col("fp_b")).alias("fp_b"),
    )
    return same.unionByName(pairs)


def document_fingerprints(docs: DataFrame, radius: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PAIRS of all documents whose fingerprints are within ``radius`` bits of each other."""
    return near_fingerprints(materialise(fingerprints(docs, id_col, text_col), "simhash"), radius, blocks)

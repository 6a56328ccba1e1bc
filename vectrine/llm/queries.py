"""Queries of the training-data operators over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from vectrine.llm import chat, cube, decontam, golay_dedup, htmltext, langid, pii, secrets, sharding, simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "shard")


def op3_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", "pred_family", "pred_lang", "margin", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(table(spark, sf_dir, "documents")).select("doc_id", "text", "pii_entities", "pii_terms")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = chat.transcripts(table(spark, sf_dir, "conversations"))
    return chat.format_chats(raw, chat.fit(raw)).select("conv_id", "transcript", "turns", "chat")


def op10_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.balanced_sample(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_sharding, op3_golay_dedup, op4_secrets, op5_language_id, op6_decontamination, op7_sanitisation, op8_simhash, op9_chat_formatting, op10_cube_mixing, pipeline)
    return {f.__name__: f for f in found}


_M = "18446744073709551616"

JUMP_SQL = f"""
WITH RECURSIVE jumps AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT::UHUGEINT AS k, 0::BIGINT AS here, 0::BIGINT AS ahead FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, n, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((n >> 33)::DOUBLE + 1)))::BIGINT FROM (SELECT doc_id, (k * 2862933555777941757 + 1) % {_M} AS n, ahead FROM jumps WHERE ahead < {sharding.SHARDS})),
last AS (SELECT doc_id, max(here) AS shard FROM jumps GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.shard, 0)::INTEGER AS shard FROM documents d LEFT JOIN last l ON d.doc_id = l.doc_id
"""

SIMHASH_SQL = f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
terms AS (SELECT doc_id, w, 1 + floor(log2(count(*)) + 1e-9)::BIGINT AS weight FROM words GROUP BY doc_id, w),
h0 AS (SELECT w, list_reduce(list_transform(list_reverse(string_split(w, '')), lambda c: (ord(c) + 1)::UHUGEINT), lambda a, b: (a * 1000003 + b) % {_M}) AS h FROM (SELECT DISTINCT w FROM terms)),
h1 AS (SELECT w, (xor(h, h >> 30) * 13787848793156543929) % {_M} AS h FROM h0),
h2 AS (SELECT w, (xor(h, h >> 27) * 10723151780598845931) % {_M} AS h FROM h1),
h3 AS (SELECT w, xor(h, h >> 31) AS h FROM h2),
votes AS (SELECT doc_id, {", ".join(f"sum(CASE WHEN (h >> {i}) % 2 = 1 THEN weight ELSE -weight END) AS v{i}" for i in range(64))} FROM terms JOIN h3 USING (w) GROUP BY doc_id),
fps AS (SELECT doc_id, ({" + ".join(f"(v{i} > 0)::HUGEINT * {1 << i}" for i in range(63))} - (v63 > 0)::HUGEINT * {1 << 63})::BIGINT AS fp FROM votes),
one AS (SELECT fp, min(doc_id) AS doc FROM fps GROUP BY fp)
SELECT doc AS doc_a, doc_id AS doc_b, 0::INTEGER AS distance, fp AS fp_a, fp AS fp_b FROM fps JOIN one USING (fp) WHERE doc_id <> doc
UNION ALL
SELECT a.doc, b.doc, bit_count(xor(a.fp, b.fp))::INTEGER, a.fp, b.fp FROM one a JOIN one b ON a.doc < b.doc AND bit_count(xor(a.fp, b.fp)) <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": JUMP_SQL, "op8_simhash": SIMHASH_SQL}

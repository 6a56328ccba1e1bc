"""Queries over the shared tables, one or more an operator, and the SQL that each is held to.

The standard collection is documents with the vector of the same number and its labels.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.functions import filters as f
from vectrine.functions import text as tx
from vectrine.functions.distance import calibrate, knn, knn_join
from vectrine.functions.statistics import qualified_percentile
from vectrine.operators import bm25, fusion, indexes, mutations, sharding
from vectrine.operators.chunking import chunk
from vectrine.operators.collection import by_ids, page, signature
from vectrine.operators.search import SearchRequest, search
from vectrine.schema import metadata
from vectrine.session import scratch_dir
from vectrine.streaming.streams import admit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Lists of the indexes whose recall is measured.
LISTS = 4
#: Rows that product codes short-list, times k.
RERANK = 160
TEXT = "the and with of er"
PROMOTED = {"lang": ("text", "lang"), "source": ("text", "source"), "n_chars": ("integral", "n_chars"), "label": ("integral", "label"), "quality": ("integral", "quality"), "toxic": ("integral", "toxic")}
COLLECTION = uuid.UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def key(column: str):
    """Document ids are text; numbers are padded so that their order is the same."""
    return F.lpad(F.col(column).cast("string"), 12, "0")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("id", key("doc_id"))


def standard(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    rows = d.join(e, "doc_id", "left").join(table(spark, sf, "labels"), "doc_id", "left")
    fields = {n: (k, c) for n, (k, c) in PROMOTED.items()} | {"tags": ("text_array", F.array("lang", "source"))}
    return rows.withColumn("metadata", metadata(**fields))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf: str, n: int = 7) -> list[float]:
    return list(table(spark, sf, "embeddings").filter(F.col("vec_id") == n).select("embedding").first()[0])


# The SQL's side of the standard collection and of each formula

DOC = "SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, * FROM documents"
STD = f"SELECT d.*, e.embedding AS vector, e.label, l.quality, l.toxic FROM ({DOC}) d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id"
Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"
DIST = {
    "cosine": lambda v: f"list_cosine_distance({v}::DOUBLE[], {Q})",
    "dot": lambda v: f"-list_inner_product({v}::DOUBLE[], {Q})",
    "euclidean": lambda v: f"list_distance({v}::DOUBLE[], {Q})",
}


def topk_sql(metric: str, where: str = "true", k: int = 10) -> str:
    return f"SELECT vec_id AS id, round(d, 6) AS distance FROM (SELECT vec_id, {DIST[metric]('embedding')} AS d FROM embeddings) WHERE {where} ORDER BY d, vec_id LIMIT {k}"


def bm25_sql(k: int, where: str = "true") -> str:
    return f"""d AS ({DOC}), tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) AS t FROM d),
len AS (SELECT id, coalesce(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')), 0) AS dl FROM d),
stat AS (SELECT count(*)::DOUBLE AS n, greatest(sum(dl)::DOUBLE / greatest(count(*), 1), 1) AS avgdl FROM len),
terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower('{TEXT}'), '[\\p{{L}}\\p{{Nd}}]+')) AS t),
tf AS (SELECT id, t, count(*)::DOUBLE AS tf FROM tok WHERE t IN (SELECT t FROM terms) GROUP BY id, t),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t),
bm AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 11) AS score FROM tf JOIN df USING (t) JOIN len USING (id), stat WHERE {where} GROUP BY id),
text_top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS text_rank FROM bm ORDER BY score DESC, id LIMIT {k})"""


def hybrid_sql(k: int, where: str = "true", wv: float = 0.5, wt: float = 0.5) -> str:
    return f"""WITH s AS ({STD}), ok AS (SELECT id FROM s WHERE {where}), {bm25_sql(4 * k, "id IN (SELECT id FROM ok)")},
vec AS (SELECT id, {DIST["cosine"]("vector")} AS dist FROM s WHERE vector IS NOT NULL AND id IN (SELECT id FROM ok)),
vec_top AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS vector_rank FROM vec ORDER BY dist, id LIMIT {4 * k}),
fused AS (SELECT coalesce(v.id, t.id) AS id, coalesce({wv} / (60 + vector_rank), 0) + coalesce({wt} / (60 + text_rank), 0) AS score, vector_rank, text_rank FROM vec_top v FULL OUTER JOIN text_top t ON v.id = t.id)
SELECT id, round(score, 9) AS score, vector_rank::INTEGER AS vector_rank, text_rank::INTEGER AS text_rank FROM fused ORDER BY fused.score DESC, id LIMIT {k}"""


# Vectors


def _topk(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return knn(vectors(spark, sf), [(0, query_vector(spark, sf))], 10, metric).select("id", F.round("distance", 6).alias("distance"))

    return run


for _name, _metric in (("vector_cosine_topk", "cosine"), ("vector_dot_topk", "dot"), ("vector_l2_topk", "euclidean")):
    QUERIES[_name], SQL[_name] = _topk(_metric), topk_sql(_metric)


@query(topk_sql("cosine", "vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500)"))
def vector_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    keep = f.compile_filter(f.both(f.equal("lang", "en"), f.gt("n_chars", 500)), promoted=PROMOTED)
    ok = documents(spark, sf).filter(keep).select(F.col("doc_id").alias("id"))
    return knn(vectors(spark, sf).join(ok, "id", "left_semi"), [(0, query_vector(spark, sf))], 10).select("id", F.round("distance", 6).alias("distance"))


@query("SELECT query, id, round(d, 6) AS distance FROM (SELECT q.vec_id AS query, r.vec_id AS id, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings r) QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) <= 5")
def vector_batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return knn_join(rows, rows, 5, "euclidean").select("query", "id", F.round("distance", 6).alias("distance"))


@query(f"WITH s AS ({STD}), {bm25_sql(10)} SELECT id, round(score, 6) AS score FROM text_top")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(documents(spark, sf), TEXT, 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH s AS ({STD}), {bm25_sql(10, "id IN (SELECT id FROM s WHERE lang = 'de' OR quality = 1)")} SELECT id, round(score, 6) AS score FROM text_top")
def bm25_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    keep = f.compile_filter(f.either(f.equal("lang", "de"), f.equal("quality", 1)), promoted=PROMOTED)
    return bm25.search(documents(spark, sf), TEXT, 10, standard(spark, sf).filter(keep).select("id")).select("id", F.round("score", 6).alias("score"))


CHANGED = DOC.replace("SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, *", "SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, * REPLACE (CASE WHEN doc_id % 10 = 0 THEN text || ' with er zzupdated' ELSE text END AS text)") + " WHERE doc_id % 7 <> 0"


def _postings(spark: SparkSession, sf: str) -> bm25.PostingsIndex:
    """Of all documents; then every tenth is changed and every seventh removed."""
    d = documents(spark, sf)
    index = bm25.PostingsIndex.build(d, _folder(spark, "postings"))
    changed = d.filter("doc_id % 10 = 0 and doc_id % 7 <> 0").select("id", F.concat("text", F.lit(" with er zzupdated")).alias("text"))
    index.apply(changed, d.filter("doc_id % 7 = 0").select("id"))
    return index


@query(f"WITH {bm25_sql(10).replace(f'({DOC})', f'({CHANGED})')} SELECT id, round(score, 6) AS score FROM text_top")
def bm25_postings_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _postings(spark, sf).search(TEXT, 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH d AS ({CHANGED}) SELECT count(*)::BIGINT AS documents, sum(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')))::BIGINT AS terms FROM d")
def bm25_postings_totals(spark: SparkSession, sf: str) -> DataFrame:
    index = _postings(spark, sf)
    index.compact()
    return spark.createDataFrame([(index.documents, index.terms)], "documents bigint, terms bigint")


@query(f"WITH {bm25_sql(1)} SELECT t AS term, df::BIGINT AS df, (SELECT n FROM stat)::BIGINT AS documents, (SELECT sum(dl) FROM len)::BIGINT AS terms FROM df")
def bm25_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    terms = bm25.query_terms(TEXT)
    sums = [F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]
    one = bm25.with_terms(d, terms).agg(F.count("*").alias("documents"), F.sum("length").alias("terms"), F.array(*[F.struct(F.lit(t).alias("term"), s.alias("df")) for t, s in zip(terms, sums)]).alias("each"))
    return one.select("documents", "terms", F.explode("each").alias("e")).select("e.term", "e.df", "documents", "terms").filter("df > 0")


@query("SELECT t AS term, count(*)::BIGINT AS total, count(DISTINCT doc_id)::BIGINT AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS t FROM documents) GROUP BY t")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = bm25.postings(documents(spark, sf))
    return p.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("docs"))


@query("SELECT doc_id, (coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{Nd}''’_]+'), lambda w: (length(w) + 3) // 4)), 0) + length(regexp_replace(text, '[\\p{L}\\p{Nd}''’_\\s]', '', 'g')))::BIGINT AS tokens FROM documents")
def approx_token_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.approximate_tokens(F.col("text")).alias("tokens"))


# Fusion and the four modes


def _hybrid(spark: SparkSession, sf: str, **options) -> DataFrame:
    request = SearchRequest(TEXT, query_vector(spark, sf), "hybrid", 10, include=("scores",), **options)
    return search(standard(spark, sf), request, promoted=PROMOTED, texts=documents(spark, sf)).select("id", F.round("score", 9).alias("score"), "vector_rank", "text_rank")


@query(hybrid_sql(10))
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf)


@query(hybrid_sql(10, "lang = 'en' AND NOT coalesce(toxic = 1, false)"))
def rrf_hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, filter=f.both(f.equal("lang", "en"), f.negate(f.equal("toxic", 1))))


@query(hybrid_sql(10, "true", 0.9, 0.2))
def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, vector_weight=0.9, text_weight=0.2)


@query(f"SELECT id, text, 1.0::DOUBLE AS score FROM ({STD}) WHERE quality IS NOT NULL AND lang IN ('fr', 'es') ORDER BY id LIMIT 25")
def metadata_mode(spark: SparkSession, sf: str) -> DataFrame:
    request = SearchRequest(mode="metadata", limit=25, filter=f.both(f.exists("quality"), f.is_in("lang", ["fr", "es"])))
    return search(standard(spark, sf), request, promoted=PROMOTED, texts=documents(spark, sf)).select("id", "text", "score")


@query(f"WITH {bm25_sql(10)} SELECT t.id, d.text, round(t.score, 6) AS score, text_rank::INTEGER AS text_rank FROM text_top t JOIN d USING (id)")
def text_mode(spark: SparkSession, sf: str) -> DataFrame:
    return search(standard(spark, sf), SearchRequest(TEXT, mode="text"), texts=documents(spark, sf)).select("id", "text", F.round("score", 6).alias("score"), "text_rank")


@query(f"SELECT id, text, round(-d, 6) AS score, (row_number() OVER (ORDER BY d, id))::INTEGER AS vector_rank FROM (SELECT id, text, {DIST['cosine']('vector')} AS d FROM ({STD}) WHERE vector IS NOT NULL) ORDER BY d, id LIMIT 10")
def vector_mode(spark: SparkSession, sf: str) -> DataFrame:
    request = SearchRequest(vector=query_vector(spark, sf), mode="vector", include=("text", "scores"))
    return search(standard(spark, sf), request, texts=documents(spark, sf)).select("id", "text", F.round("score", 6).alias("score"), "vector_rank")


# Filters: on the metadata map (m) and on promoted columns, which must agree

FILTERS: dict[str, tuple[f.Filter, str]] = {
    "filter_equal": (f.equal("lang", "de"), "lang = 'de'"),
    "filter_not_equal": (f.not_equal("quality", 1), "NOT coalesce(quality = 1, false)"),
    "filter_gt": (f.gt("n_chars", 2000), "n_chars > 2000"),
    "filter_gte": (f.gte("label", 5), "coalesce(label >= 5, false)"),
    "filter_lt": (f.lt("n_chars", 300), "n_chars < 300"),
    "filter_lte": (f.lte("label", 2), "coalesce(label <= 2, false)"),
    "filter_in": (f.is_in("source", ["src1", "src2", "nowhere"]), "source IN ('src1', 'src2')"),
    "filter_exists": (f.exists("toxic"), "toxic IS NOT NULL"),
    "filter_and": (f.both(f.equal("lang", "en"), f.gt("n_chars", 1000), f.equal("quality", 1)), "lang = 'en' AND n_chars > 1000 AND coalesce(quality = 1, false)"),
    "filter_or": (f.either(f.equal("toxic", 1), f.equal("label", 3)), "coalesce(toxic = 1, false) OR coalesce(label = 3, false)"),
    "filter_not": (f.negate(f.either(f.gt("label", 4), f.equal("lang", "en"))), "NOT (coalesce(label > 4, false) OR lang = 'en')"),
    "filter_array_contains": (f.both(f.equal("tags", "src3"), f.not_equal("tags", "fr")), "source = 'src3' AND lang <> 'fr'"),
    "filter_missing_field": (f.both(f.negate(f.gt("quality", 0)), f.not_equal("nothing", 1)), "NOT coalesce(quality > 0, false)"),
    "filter_kind_tagged": (f.both(f.not_equal("quality", 1.0), f.gte("quality", 0.5)), "coalesce(quality >= 0.5, false)"),
}


def _filter(tree: f.Filter, promoted: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return standard(spark, sf).filter(f.compile_filter(tree, promoted=PROMOTED if promoted else None)).select("id")

    return run


for _name, (_tree, _where) in FILTERS.items():
    QUERIES[_name], QUERIES[f"{_name}_promoted"] = _filter(_tree, False), _filter(_tree, True)
    SQL[_name] = SQL[f"{_name}_promoted"] = f"SELECT id FROM ({STD}) WHERE {_where}"


@query("SELECT user_id, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'view'")
def filter_datetime(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import datetime

    rows = table(spark, sf, "events").withColumn("metadata", metadata(ts=("datetime", F.col("ts").cast("timestamp")), event_type=("text", "event_type")))
    tree = f.both(f.gte("ts", datetime(2024, 1, 10)), f.not_equal("event_type", "view"))
    return rows.filter(f.compile_filter(tree)).select("user_id", "event_id")


# Reads


@query("SELECT count(*)::BIGINT AS documents FROM documents")
def count_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("documents"))


@query(f"SELECT id, text FROM ({DOC}) ORDER BY id LIMIT 20 OFFSET 40")
def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    _, token = page(d, "documents", 1, 40)
    return page(d, "documents", 1, 20, token=token)[0].select("id", "text")


@query(f"SELECT id, text, p AS position FROM (SELECT unnest(['000000000009', '000000000002', '000000000150']) AS id, unnest([1, 2, 3]) AS p) JOIN ({DOC}) USING (id)")
def get_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = by_ids(documents(spark, sf), ["000000000009", "000000000002", "missing", "000000000009", "000000000150"])
    return rows.select("id", "text").withColumn("position", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


@query(
    f"""WITH l AS (SELECT sha256(id || chr(0) || '1') AS h FROM ({DOC})),
p AS (SELECT substr(h, 1, 3) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM l GROUP BY substr(h, 1, 3)) SELECT sha256(string_agg(h, '' ORDER BY h)) AS signature FROM p"""
)
def document_signature(spark: SparkSession, sf: str) -> DataFrame:
    return signature(documents(spark, sf).select("id", F.lit(1).alias("version")), digits=3)


# Change logs


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a change log: key user_id, order event_id, a purchase deletes."""
    return table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert").alias("op"), "value")


@query("SELECT user_id AS id, event_id AS seq, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'purchase'")
def latest_version_log(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.latest(_log(spark, sf)).select("id", "seq", "value")


def _mutations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents at version 3, with vectors and metadata, and events as mutations of those of the same number."""
    d = documents(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.slice("embedding", 1, 2).alias("vector")), "doc_id", "left")
    current = d.select("id", "text", "vector", metadata(lang=("text", "lang")).alias("metadata"), F.lit(3).cast("bigint").alias("version"))
    kind = F.element_at(F.array(*map(F.lit, mutations.KINDS)), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    every = lambda n, c: F.when(F.pmod("event_id", F.lit(n)) > 0, c)
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), key("user_id").alias("id"), every(3, F.col("event_type")).alias("text"), every(5, F.array(F.col("value").cast("float"), F.lit(1.0).cast("float"))).alias("vector"), every(2, metadata(type=("text", "event_type"))).alias("metadata"))
    return current, e


FOLD_SQL = f"""WITH RECURSIVE m AS (SELECT lpad(user_id::VARCHAR, 12, '0') AS id, event_id AS seq, event_id % 4 AS k, CASE WHEN event_id % 3 > 0 THEN event_type END AS text, CASE WHEN event_id % 5 > 0 THEN value::FLOAT END AS x, CASE WHEN event_id % 2 > 0 THEN 's:' || event_type END AS meta, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT i.id, 0::BIGINT AS n, 0::BIGINT AS seq, CASE WHEN d.id IS NULL THEN 0 ELSE 3 END::BIGINT AS version, d.text, v.embedding[1]::FLOAT AS x, 's:' || d.lang AS meta, NULL::VARCHAR AS error_code FROM (SELECT DISTINCT id FROM m) i LEFT JOIN ({DOC}) d ON d.id = i.id LEFT JOIN embeddings v ON v.vec_id = d.doc_id
UNION ALL SELECT id, n, seq, CASE WHEN e IS NOT NULL THEN version WHEN k = 3 THEN 0 ELSE version + 1 END, {", ".join(f"CASE WHEN e IS NOT NULL THEN {c}0 WHEN k = 3 THEN NULL WHEN k = 2 THEN coalesce({c}1, {c}0) ELSE {c}1 END" for c in ("text", "x", "meta"))}, e
FROM (SELECT m.id, m.n, m.seq, s.version, m.k, m.text AS text1, s.text AS text0, m.x AS x1, s.x AS x0, m.meta AS meta1, s.meta AS meta0, CASE WHEN m.k = 0 AND s.version > 0 THEN 'document_already_exists' WHEN m.k IN (2, 3) AND s.version = 0 THEN 'document_not_found' WHEN m.k = 2 AND m.text IS NULL AND m.x IS NULL AND m.meta IS NULL THEN 'empty_update' END AS e FROM s JOIN m ON m.id = s.id AND m.n = s.n + 1))"""


@query(FOLD_SQL + " SELECT id, version, text, round(x::DOUBLE, 4) AS x, meta FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1 AND version > 0 AND count(*) FILTER (n > 0 AND error_code IS NULL) OVER (PARTITION BY id) > 0")
def upsert_patch_delete(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = mutations.fold(*_mutations(spark, sf), atomic=False)
    meta = F.coalesce(F.col("metadata")["type"], F.col("metadata")["lang"])["keys"][0]
    return rows.filter("op = 'upsert'").select("id", "version", "text", F.round(F.col("vector")[0].cast("double"), 4).alias("x"), meta.alias("meta"))


@query(FOLD_SQL + " SELECT coalesce(error_code, 'ok') AS outcome, count(*)::BIGINT AS mutations FROM s WHERE n > 0 GROUP BY 1")
def mutation_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    results, _ = mutations.fold(*_mutations(spark, sf), atomic=False)
    return results.groupBy(F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("mutations"))


ATOMIC_SQL = """WITH c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch, lpad(user_id::VARCHAR, 12, '0') AS id, event_id AS seq, user_id FROM events),
e AS (SELECT batch, min(seq) AS seq FROM c WHERE user_id % 2 = 1 AND seq % 1000 = 999 GROUP BY batch)
SELECT c.seq, c.batch, e.seq IS NULL AS succeeded, CASE WHEN e.seq IS NOT NULL THEN 'document_not_found' END AS error_code, CASE WHEN e.seq IS NULL THEN row_number() OVER (PARTITION BY c.id ORDER BY c.seq) END::BIGINT AS version FROM c LEFT JOIN e USING (batch)"""


@query(ATOMIC_SQL)
def atomic_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches on an empty collection: upserts of even users, which all succeed; and of odd ones, with some updates of
    what isn't there, of which the first fails them all."""
    current, batch = _mutations(spark, sf)
    even = F.pmod(F.col("id").cast("bigint"), F.lit(2)) == 0
    out = None
    for name, part in (("even", batch.filter(even)), ("odd", batch.filter(~even))):
        lost = F.pmod("seq", F.lit(1000)) == 999
        part = part.withColumn("kind", F.when(lost & ~even, "update").otherwise("upsert")).withColumn("id", F.when(lost & ~even, F.concat(F.lit("gone-"), "seq")).otherwise(F.col("id"))).withColumn("text", F.coalesce("text", F.lit("x")))
        one = mutations.fold(current.limit(0), part, atomic=True)[0].select("seq", F.lit(name).alias("batch"), "succeeded", "error_code", "version")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH e AS (SELECT user_id AS id, (event_id * 7919) % 1000 AS version, event_id AS value, event_id % 2 AS side, event_id % 5 = 3 AS gone, event_id % 97 = 3 AS wiped FROM events),
stored AS (SELECT id, version, max(value) AS value FROM e WHERE side = 0 GROUP BY id, version QUALIFY version = max(version) OVER (PARTITION BY id)),
i AS (SELECT id, CASE WHEN wiped THEN 0 ELSE version END AS version, max(value) AS value, bool_or(gone OR wiped) AS gone FROM e WHERE side = 1 GROUP BY ALL),
both_ AS (SELECT *, false AS gone, 1 AS kept FROM stored UNION ALL SELECT *, 0 FROM i)
SELECT id, version, value FROM both_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY gone AND version = 0 DESC, version DESC, kept DESC) = 1 AND NOT gone"""
)
def version_gated_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Even events are what is stored, odd ones come in: a fifth deletes, some of version 0; ties stay as they are stored."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), (F.col("event_id") * 7919 % 1000).alias("version"), F.col("event_id").alias("value"), "event_id")
    best = e.filter("event_id % 2 = 0").groupBy("id", "version").agg(F.max("value").alias("value"))
    stored = best.groupBy("id").agg(F.max(F.struct("version", "value")).alias("b")).select("id", "b.*")
    wiped = F.col("event_id") % 97 == 3
    came = e.filter("event_id % 2 = 1").withColumn("version", F.when(wiped, 0).otherwise(F.col("version"))).groupBy("id", "version").agg(F.max("value").alias("value"), F.bool_or((F.col("event_id") % 5 == 3) | wiped).alias("gone"))
    return mutations.apply_by_version(stored, came.withColumn("op", F.when(F.col("gone"), "delete").otherwise("upsert")).drop("gone")).select("id", "version", "value")


# Shards


SHARD_SQL = f"SELECT id, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 1024)::INTEGER AS shard_id FROM (SELECT id, sha256(unhex('{COLLECTION.bytes_le.hex()}') || encode(id)) AS h FROM ({DOC}))"


@query(SHARD_SQL)
def shard_routing(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", sharding.stable_shard(COLLECTION, F.col("id")).alias("shard_id"))


def _placed(spark: SparkSession, df: DataFrame) -> DataFrame:
    return sharding.route(df, COLLECTION, sharding.initial_placement(spark, COLLECTION, ["g1", "g2", "g3"]))


@query(f"SELECT lpad(vec_id::VARCHAR, 12, '0') AS id, round(-d, 6) AS score FROM (SELECT vec_id, {DIST['cosine']('embedding')} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def sharded_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).withColumn("id", key("id"))
    return sharding.sharded_vector_topk(_placed(spark, v), query_vector(spark, sf), 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql(10)} SELECT id, round(score, 6) AS score FROM text_top")
def sharded_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharded_text_topk(_placed(spark, documents(spark, sf)), TEXT, 10).select("id", F.round("score", 6).alias("score"))


@query(hybrid_sql(10))
def sharded_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    rows = sharding.sharded_hybrid_topk(_placed(spark, standard(spark, sf)), query_vector(spark, sf), TEXT, 10, texts=_placed(spark, documents(spark, sf)))
    return rows.select("id", F.round("score", 9).alias("score"), "vector_rank", "text_rank")


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 10 = 0 THEN 'delete' ELSE 'upsert' END AS kind FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0")
def shard_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "doc_id")
    now = d.filter("doc_id % 10 <> 0").withColumn("text", F.when(F.expr("doc_id % 7 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return sharding.shard_delta(d, now)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


# Quantization and indexes


@query("SELECT (i - 1)::INTEGER AS dim, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i")
def int8_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate(vectors(spark, sf)).select("dim", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


@query(topk_sql("cosine"))
def int8_rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.build_index("flat_int8", vectors(spark, sf), _folder(spark, "int8")).nearest(query_vector(spark, sf), 10).select("id", F.round("distance", 6).alias("distance"))


@query(topk_sql("cosine"))
def float16_rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.build_index("flat_float16", vectors(spark, sf), _folder(spark, "float16")).nearest(query_vector(spark, sf), 10).select("id", F.round("distance", 6).alias("distance"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _truth(rows: DataFrame, k: int, path: str) -> DataFrame:
    """The exact join of ``rows`` with themselves, written once."""
    knn_join(rows, rows, k).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


@query(topk_sql("cosine"))
def ivf_exact_probe_all(spark: SparkSession, sf: str) -> DataFrame:
    index = indexes.IvfIndex.build(vectors(spark, sf), _folder(spark, "ivf"), lists=4)
    return index.search(query_vector(spark, sf), 10, nprobe=4).select("id", F.round("distance", 6).alias("distance"))


@query()
def ivf_pq_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = indexes.IvfIndex.build(vectors(spark, sf), _folder(spark, "pq"), lists=4, subvectors=8, codes=8)
    return index.search(query_vector(spark, sf), 10, nprobe=2).select("id", F.round("distance", 6).alias("distance"))


@query()
def hnsw_topk(spark: SparkSession, sf: str) -> DataFrame:
    graphs = indexes.graph_build(vectors(spark, sf), _folder(spark, "hnsw"), "hnsw", 1000, m=8, ef=64)
    return indexes.graph_search(graphs, query_vector(spark, sf), 10).select("id", F.round("distance", 6).alias("distance"))


@query()
def vamana_topk(spark: SparkSession, sf: str) -> DataFrame:
    graphs = indexes.graph_build(vectors(spark, sf), _folder(spark, "vamana"), "vamana", 1000, degree=16, width=32)
    return indexes.graph_search(graphs, query_vector(spark, sf), 10).select("id", F.round("distance", 6).alias("distance"))


@query("SELECT 1.0::DOUBLE AS recall")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors ask an index, all lists of which are probed, so that it must find what the exact join does."""
    rows = vectors(spark, sf)
    index = indexes.IvfIndex.build(rows, _folder(spark, "recall"), lists=LISTS)
    return fusion.recall_at(index.search_join(rows, 5, LISTS), _truth(rows, 5, _folder(spark, "truth")), 5)


@query()
def recall_at_k_probed(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of all vectors by the share of the lists that is probed, of inverted lists with and without product codes."""
    rows = vectors(spark, sf)
    truth = _truth(rows, 5, _folder(spark, "truth"))
    out = None
    for kind, options in (("ivf", {}), ("ivf_pq", {"subvectors": 8, "codes": 8})):
        index = indexes.IvfIndex.build(rows, _folder(spark, kind), lists=LISTS, **options)
        for nprobe in (1, 2, 3):
            one = fusion.recall_at(index.search_join(rows, 5, nprobe, RERANK), truth, 5).select(F.lit(kind).alias("kind"), F.lit(LISTS).alias("lists"), F.lit(nprobe).alias("nprobe"), "recall")
            out = one if out is None else out.unionByName(one)
    return out


# Text and ingestion

MESSY = "concat(chr(13), text, '  ', chr(9), lang, ' ', chr(13), chr(10), chr(10), chr(10), chr(10), source, chr(13))"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({MESSY}, '\\r\\n?', chr(10), 'g'), '[^\\S\\n]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), '') AS text FROM documents")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.normalize_text(F.expr(MESSY.replace("chr", "char"))).alias("text"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.content_hash(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(substr(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', ''), 1, 96), '[^\\p{L}\\p{Nd}\\-_.]', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')) AS stem, ':' || substr(sha256(html), 1, 16) || ':' || lpad((page_id % 1000)::VARCHAR, 5, '0') AS rest FROM pages")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    ids = tx.chunk_id(tx.document_id(F.col("url"), F.sha2("html", 256)), F.col("page_id") % 1000)
    parts = p.select("page_id", ids.alias("id"))
    return parts.select("page_id", F.when(F.regexp_extract("id", "^([^:]*)", 1) == "document", "").otherwise(F.regexp_extract("id", "^([^:]*)", 1)).alias("stem"), F.regexp_extract("id", "(:.*)$", 1).alias("rest"))


@query()
def chunked_documents(spark: SparkSession, sf: str) -> DataFrame:
    section = F.array(F.struct(F.lit(0).alias("sequence"), F.lit("Document").alias("location"), F.lit(None).cast("string").alias("heading"), tx.normalize_text(F.col("text")).alias("text")))
    return chunk(table(spark, sf, "documents").select("doc_id", section.alias("sections"))).select("doc_id", "sequence", "text", "estimated_tokens")


@query("SELECT conv_id, CASE WHEN len(l) <= 6 THEN [l] ELSE list_transform(range(0, ((len(l) - 2 + 3) // 4)::BIGINT), lambda i: [l[1]] || l[2 : len(l) - 1][i * 4 + 1 : i * 4 + 4] || [l[len(l)]]) END AS windows FROM (SELECT conv_id, list(turn ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ids"))
    return ids.select("conv_id", tx.token_windows(F.col("ids"), 6).alias("windows"))


@query(
    """WITH RECURSIVE m AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
s AS (SELECT user_id, event_id, t, n, 1.0::DOUBLE AS tokens, true AS accepted FROM m WHERE n = 1
UNION ALL SELECT user_id, event_id, t, n, CASE WHEN h >= 1 THEN h - 1 ELSE h END, h >= 1 FROM (SELECT m.*, least(2.0::DOUBLE, s.tokens + (m.t - s.t) * 0.01::DOUBLE) AS h FROM s JOIN m ON m.user_id = s.user_id AND m.n = s.n + 1))
SELECT user_id, event_id, accepted FROM s"""
)
def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """Admission of events by a bucket a user: 1 token in 100 seconds, burst 2."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return admit(e, 0.01, 2).select(F.col("client").alias("user_id"), F.col("request").alias("event_id"), "accepted")



# Aggregates of benchmarks and planners


@query("SELECT event_type, user_id % 40 AS part, count(*)::BIGINT AS n, min(value) AS low, max(value) AS high, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS deviation, CASE WHEN count(*) >= 20 THEN round(quantile_cont(value, 0.95), 6) END AS p95, CASE WHEN count(*) >= 100 THEN round(quantile_cont(value, 0.99), 6) END AS p99 FROM events GROUP BY 1, 2")
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Of small groups too, whose percentiles have too few values behind them."""
    e = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 40).alias("part"))
    p = lambda x: F.round(qualified_percentile(F.col("value"), x), 6)
    return e.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("deviation"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query(f"SELECT data_group, count(*)::BIGINT AS documents FROM (SELECT CASE ((shard_id + o) % 3) WHEN 0 THEN 'g1' WHEN 1 THEN 'g2' ELSE 'g3' END AS data_group FROM ({SHARD_SQL}), (SELECT ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 3 AS o FROM (SELECT sha256(unhex('{COLLECTION.bytes_le.hex()}') || encode('{COLLECTION.hex}')) AS h))) GROUP BY 1")
def documents_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, documents(spark, sf)).groupBy("data_group").agg(F.count("*").alias("documents"))


@query("SELECT doc_id % 5 AS bucket, (128 + 18 + sum(48 + 2 * length(doc_id::VARCHAR) + 2 * length(text)))::BIGINT AS bytes FROM documents GROUP BY 1")
def write_size_estimate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select((F.col("doc_id") % 5).alias("bucket"), F.col("doc_id").cast("string").alias("id"), "text")
    row = F.lit(48) + 2 * F.length("id") + 2 * F.length("text")
    return d.groupBy("bucket").agg((F.lit(128 + 18) + F.sum(row)).cast("bigint").alias("bytes"))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def queries() -> dict[str, Query]:
    return dict(QUERIES)

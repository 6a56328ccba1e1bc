from __future__ import annotations

import io
import os
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrine import queries
from vectrine.functions import distance, statistics
from vectrine.functions.distance import knn
from vectrine.operators import indexes, mutations
from vectrine.operators.chunking import ChunkOptions, chunk_sections, count_tokens
from vectrine.operators.collection import Catalog, by_ids, page, signature
from vectrine.operators.embedding import embed_text
from vectrine.operators.fusion import recall_at
from vectrine.operators.search import SearchRequest
from vectrine.plans import lifecycle, placement
from vectrine.schema import DomainError
from vectrine.sources import files
from vectrine.streaming import streams

BATCH = "seq bigint, kind string, id string, text string, vector array<float>, metadata map<string,struct<kind:tinyint,keys:array<string>,nums:array<double>>>"


def batch(spark, *rows):
    return spark.createDataFrame([(i + 1, *(tuple(r) + (None,) * (5 - len(r)))) for i, r in enumerate(rows)], BATCH)


def state(c):
    return {r.id: (r.text, r.version) for r in c.documents().collect()}


@pytest.fixture()
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}")


def test_mutations_fold_in_order(spark, catalog):
    c = catalog.create("docs", 2)
    r = c.mutate(batch(spark, ("add", "a", "one", [1.0, 0.0]), ("update", "a", "two"), ("upsert", "b", "x", [0.0, 1.0]), ("delete", "b"), ("add", "b", "again", [1.0, 1.0])))
    assert [(x.seq, x.succeeded, x.version) for x in r.orderBy("seq").collect()] == [(1, True, 1), (2, True, 2), (3, True, 1), (4, True, 2), (5, True, 1)]
    assert state(c) == {"a": ("two", 2), "b": ("again", 1)} and c.count() == 2
    assert c.get(["a"]).first().vector == [1.0, 0.0]
    r = c.mutate(batch(spark, ("add", "a", "no", [1.0, 0.0]), ("update", "zz", "no"), ("update", "a"), ("delete", "b"), ("upsert", "d", "bad", [1.0])), atomic=False)
    assert [(x.seq, x.error_code) for x in r.orderBy("seq").collect()] == [(1, "document_already_exists"), (2, "document_not_found"), (3, "empty_update"), (4, None), (5, "dimension_mismatch")]
    assert state(c) == {"a": ("two", 2)}
    c.compact()
    assert state(c) == {"a": ("two", 2)} and c.manifest()["count"] == 1 and not c.manifest()["segments"]


def test_atomic_batch_is_all_or_nothing(spark, catalog):
    c = catalog.create("docs", 2)
    r = c.mutate(batch(spark, ("add", "a", "x", [1.0, 0.0]), ("add", "b", "x", [1.0, 0.0, 0.0]))).collect()
    assert {x.error_code for x in r} == {"dimension_mismatch"} and c.count() == 0
    r = c.mutate(batch(spark, ("add", "a", "x", [1.0, 0.0]), ("delete", "b"))).collect()
    assert {(x.succeeded, x.error_code) for x in r} == {(False, "document_not_found")} and c.count() == 0
    with pytest.raises(DomainError, match="invalid_batch_size"):
        c.mutate(batch(spark, ("delete", "a"), ("delete", "a")), maximum=1)


def test_one_bad_row_fails_alone(spark, catalog):
    c = catalog.create("docs", 2)
    rows = (("upsert", "x", "bad", [1.0]), ("update", "x", "early"), ("upsert", "x", "good", [1.0, 0.0]), ("upsert", None, "no id", [1.0, 0.0]), ("upsert", "big", "w " * 100_001, [1.0, 0.0]), ("update", "x", "late"), ("upsert", " ", "blank", [1.0, 0.0]), ("delete", None))
    r = c.mutate(batch(spark, *rows), atomic=False)
    codes = ["dimension_mismatch", "document_not_found", None, "invalid_document_id", "text_too_large", None, "invalid_document_id", "invalid_document_id"]
    assert [x.error_code for x in r.orderBy("seq").collect()] == codes and state(c) == {"x": ("late", 2)}
    r = c.mutate(batch(spark, ("upsert", "y", "bad", [1.0]), ("upsert", None, "bad", None)), atomic=False)
    assert [x.error_code for x in r.orderBy("seq").collect()] == ["dimension_mismatch", "invalid_document_id"]
    r = c.mutate(batch(spark, ("upsert", "y", "good", [1.0, 0.0]), ("upsert", None, "bad", None), ("upsert", "z", "bad", [1.0])))
    assert {(x.succeeded, x.error_code, x.version) for x in r.collect()} == {(False, "invalid_document_id", None)} and state(c) == {"x": ("late", 2)}
    r = c.mutate(batch(spark, ("upsert", "y", "good", [1.0, 0.0]), ("update", "y", None, [0.0, 1.0])))
    assert {x.version for x in r.collect()} == {1, 2} and c.get(["y"]).first().vector == [0.0, 1.0] and c.get(["y"]).first().text == "good"


def test_storage_fails_closed_and_takes_one_writer(spark, catalog):
    c = catalog.create("docs", 2)
    c.mutate(batch(spark, ("upsert", "a", "x", [1.0, 0.0])))
    other = catalog.get("docs")
    c.manifest(), other.manifest()
    rows = c.documents().withColumn("op", F.lit("upsert"))
    seen = other.manifest
    other.manifest = lambda stale=False, m=other.manifest(): m
    c.append(rows.withColumn("version", F.lit(2).cast("bigint")))
    with pytest.raises(DomainError, match="concurrent_write"):
        other.append(rows)
    other.manifest = seen
    assert state(other) == {"a": ("x", 2)} and c.verify()
    stale = SearchRequest(mode="metadata", include=("text",), consistency="stale")
    assert other.search(stale).count() == 1
    c.mutate(batch(spark, ("delete", "a")))
    assert other.search(stale).count() == 1 and other.search(SearchRequest(mode="metadata")).count() == 0
    number, m = c.store.latest(f"{c.folder}/manifests")
    c.store.put_if_absent(f"{c.folder}/manifests/{number:012d}.json", b'{"seal": "half')  # a writer that died
    assert c.store.latest(f"{c.folder}/manifests") == (number + 1, m) and c.count() == 0
    c.mutate(batch(spark, ("upsert", "b", "y", [1.0, 0.0])))
    assert state(c) == {"b": ("y", 1)} and c.verify()
    segment = c.manifest()["segments"][-1]["name"]
    rows.write.mode("overwrite").parquet(c.store.at(f"{c.folder}/log/{segment}/"))
    assert not c.verify()
    c.store.delete(f"{c.folder}/manifests")
    with pytest.raises(DomainError, match="manifest_missing"):
        c.count()


def test_backups_address_content(spark, catalog):
    c = catalog.create("docs", 2)
    c.mutate(batch(spark, ("upsert", "a", "x", [1.0, 0.0])))
    one = catalog.backup()
    assert catalog.verify(one)
    blob = catalog._backup(one)["collections"][0]["blob"]
    changed = catalog._blob(blob).withColumn("text", F.lit("another")).cache()
    changed.count()
    changed.write.mode("overwrite").parquet(catalog.store.at(f"backups/blobs/{blob}"))
    assert not catalog.verify(one)
    with pytest.raises(DomainError, match="backup_corrupted"):
        catalog.restore(one)


def test_documents_do_not_sort_the_snapshot(spark, catalog):
    c = catalog.create("docs", 2)
    c.mutate(batch(spark, ("upsert", "a", "x", [1.0, 0.0]), ("upsert", "b", "x", [1.0, 0.0])))
    c.compact()
    c.mutate(batch(spark, ("upsert", "a", "y", [1.0, 0.0]), ("delete", "b")))
    plan = c.documents()._jdf.queryExecution().executedPlan().toString()
    snapshot = plan.split("Union")[1].split("Window")[0]
    assert state(c) == {"a": ("y", 2)} and "SortMergeJoin" not in snapshot and "BroadcastHashJoin" in plan


def test_signature_is_of_ids_and_versions_whatever_the_order(spark):
    rows = [(f"id{i}", i % 3) for i in range(50)]
    import hashlib

    frame = lambda r: spark.createDataFrame(r, "id string, version bigint")
    h = sorted(hashlib.sha256(f"{i}\0{v}".encode()).hexdigest() for i, v in rows)
    assert signature(frame(rows)).first().signature == signature(frame(rows[::-1])).first().signature == hashlib.sha256("".join(h).encode()).hexdigest()
    parts = sorted(p + hashlib.sha256("".join(x for x in h if x[0] == p).encode()).hexdigest() for p in {x[0] for x in h})
    assert signature(frame(rows), digits=1).first().signature == hashlib.sha256("".join(parts).encode()).hexdigest()


def test_catalog_backup_and_restore(spark, catalog):
    c = catalog.create("docs", 2)
    c.mutate(batch(spark, ("add", "a", "database", [1.0, 0.0]), ("add", "b", "search", [0.0, 1.0])))
    assert [r.id for r in c.search(SearchRequest("search", [1.0, 0.0], limit=1, text_weight=1.0, vector_weight=0.1)).collect()] == ["b"]
    for bad in ("", "-a", "a b", "x" * 129):
        with pytest.raises(DomainError, match="invalid_collection_name"):
            catalog.create(bad, 2)
    with pytest.raises(DomainError, match="collection_already_exists"):
        catalog.create("docs", 2)
    first = catalog.backup()
    c.mutate(batch(spark, ("delete", "a")))
    second = catalog.backup(first)
    assert catalog.backups() == [first, second] and catalog.verify(first) and catalog.verify(second)
    assert catalog.restore(first, "docs", "old") == ["old"] and state(catalog.get("old")) == {"a": ("database", 1), "b": ("search", 1)}
    catalog.restore(first, "docs", overwrite=True)
    assert set(state(catalog.get("docs"))) == {"a", "b"}
    assert len(catalog.retain(1)) == 1 and catalog.backups() == [second]
    assert catalog.update("old", "older").definition.name == "older" and catalog.list() == ["docs", "older"]
    catalog.delete("older")
    assert catalog.list() == ["docs"]
    with pytest.raises(DomainError, match="collection_not_found"):
        catalog.get("older")


def test_paging(spark):
    docs = spark.createDataFrame([(f"{i:03d}",) for i in range(7)], "id string")
    rows, token, seen = None, None, []
    while True:
        rows, token = page(docs, "c", 1, 3, token=token)
        seen += [r.id for r in rows.collect()]
        if token is None:
            break
    assert seen == [f"{i:03d}" for i in range(7)]
    _, token = page(docs, "c", 1, 3)
    for args in (("d", 1), ("c", 2)):
        with pytest.raises(DomainError, match="invalid_continuation_token"):
            page(docs, *args, 3, token=token)
    with pytest.raises(DomainError):
        page(docs, "c", 1, 3, offset=10_001)
    assert [r.id for r in by_ids(docs, ["005", "x", "001", "005"]).collect()] == ["005", "001"]


def test_apply_by_version(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), ("c", 2, "z")], "id string, version bigint, text string")
    new = spark.createDataFrame([("a", 3, "x3", "upsert"), ("a", 2, "x2", "upsert"), ("b", 4, "old", "upsert"), ("c", 0, None, "delete"), ("d", 1, "new", "upsert"), ("d", 1, "new", "upsert")], "id string, version bigint, text string, op string")
    once = mutations.apply_by_version(now, new)
    want = {("a", 3, "x3"), ("b", 5, "y"), ("d", 1, "new")}
    assert {tuple(r) for r in once.collect()} == want and {tuple(r) for r in mutations.apply_by_version(once, new).collect()} == want


# Indexes


def vectors(spark, n=640, d=8, seed=1):
    x = np.random.default_rng(seed).uniform(0, 10, (n, d)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>").cache(), x


def test_quantized(spark, tmp_path):
    rows = spark.createDataFrame([("far", [10.0] * 4), ("nearest", [1.0, 2.0, 3.0, 4.0]), ("middle", [4.0] * 4)], "id string, vector array<float>")
    for q in ("float16", "int8"):
        assert [r.id for r in indexes.build_index(f"flat_{q}", rows, str(tmp_path / q), "euclidean").nearest([1, 2, 3, 4], 1).collect()] == ["nearest"]


def test_inverted_lists(spark, tmp_path):
    rows, x = vectors(spark)
    truth = knn(rows, [(i, x[i].tolist()) for i in range(20)], 10, "euclidean")
    exact = indexes.IvfIndex.build(rows, str(tmp_path / "a"), 4, "euclidean")
    assert [r.id for r in exact.search(x[3].tolist(), 10, 4).collect()] == [r.id for r in truth.filter("query = 3").orderBy("distance", "id").collect()]
    plan = exact.search(x[3].tolist(), 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan
    coded = indexes.IvfIndex.build(rows, str(tmp_path / "b"), 4, "euclidean", subvectors=2, codes=16)
    found = [(i, r.id) for i in range(20) for r in coded.search(x[i].tolist(), 10, 4, 8).collect()]
    assert recall_at(spark.createDataFrame(found, "query bigint, id bigint"), truth, 10).first().recall >= 0.8
    few = indexes.IvfIndex.build(rows.limit(150), str(tmp_path / "c"), 4, "euclidean")
    assert few.centroids is None and few.search(x[0].tolist(), 1).first().id == 0
    with pytest.raises(DomainError, match="invalid_index_configuration"):
        indexes.IvfIndex.build(rows, str(tmp_path / "d"), 4, subvectors=3, codes=16)
    assert [indexes.state(0, 0, 4), indexes.state(100, 0, 4), indexes.state(200, 200, 4), indexes.state(400, 200, 4)] == ["untrained", "collecting", "active", "needs_retrain"]


def test_search_of_a_table(spark, tmp_path):
    """The join finds what one search a query does, by brute force too, in blocks of any size."""
    rows, x = vectors(spark, 320)
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2))
    truth = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:5]}
    for name, options in (("a", {}), ("b", {"subvectors": 2, "codes": 8})):
        index = indexes.IvfIndex.build(rows, str(tmp_path / name), 4, "euclidean", **options)
        for nprobe, block_rows in ((1, 20_000), (2, 30), (4, 100)):
            found = {(r.query, r.id) for r in index.search_join(rows, 5, nprobe, 4, block_rows).collect()}
            assert len(found) == 5 * len(x)
            for i in (0, 7, 319):
                assert {b for a, b in found if a == i} == {r.id for r in index.search(x[i].tolist(), 5, nprobe, 4).collect()}
            share = len(found & truth) / len(truth)
            assert share == 1 if (name, nprobe) == ("a", 4) else share < 1
    few = indexes.IvfIndex.build(rows.limit(100), str(tmp_path / "c"), 4, "euclidean")
    assert few.centroids is None and {r.query for r in few.search_join(rows, 1).collect()} == set(range(320))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["text_mode", "vector_mode", "metadata_mode", "rrf_hybrid_filtered", "bm25_filtered_topk"])
def test_texts_are_not_shuffled(spark, tmp_path, name):
    """Only scores and ids meet the vectors and labels, which are too large to broadcast."""
    make = spark.createDataFrame
    make([(i, f"the cat {'of' * (i % 3)} and {i}", "en" if i % 2 else "fr" if name == "metadata_mode" else "de", "s", 600) for i in range(60)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    make([(i, [1.0, i / 7], i % 3) for i in range(50)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    make([(i, i % 2, i % 5 // 4) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.queries()[name](spark, str(tmp_path))
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        scans = [i for i, x in enumerate(lines) if "FileScan" in x and "text#" in x]
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        assert scans
        for i in scans:  # upwards from the scan, up to where texts end or meet the hits
            least = depth(lines[i])
            for x in reversed(lines[:i]):
                if depth(x) < least:
                    least = depth(x)
                    assert "Exchange hashpartitioning" not in x
                    if "ArrowEvalPython" in x or "BroadcastHashJoin" in x:
                        break
        assert df.count() == (20 if name == "metadata_mode" else 10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_coded_short_lists_stay_in_their_task(spark, tmp_path):
    """They are never shuffled for a window, and a task holds half as many rows again as they have."""
    rows, _ = vectors(spark, 320)
    index = indexes.IvfIndex.build(rows, str(tmp_path / "a"), 4, "euclidean", subvectors=2, codes=8)
    assert "Window" not in plan_of(index.search_join(rows, 5, 3, 100))
    rng = np.random.default_rng(5)
    near, d = rng.integers(0, 300, 5000).astype(float), rng.random(5000)
    lists = distance.ShortLists(np.zeros((1, 2)), 100, "euclidean")
    for at in range(0, 5000, 50):
        lists.extend(0, np.arange(5000)[at : at + 50], near[at : at + 50], d[at : at + 50])
        assert sum(len(p[0]) for p in lists.own[0]) <= 150
    some = np.lexsort((np.arange(5000), near))[:100]
    assert lists.nearest(7)[1].tolist() == some[np.argsort(d[some])][:7].tolist()


def test_join_with_lists_leaves_only_results(spark, tmp_path):
    """All lists are probed by one task for a query, so nothing is left to merge."""
    rows, _ = vectors(spark, 320)
    index = indexes.IvfIndex.build(rows, str(tmp_path / "a"), 4, "euclidean")
    found = index.search_join(rows, 5, 4)
    assert "Window" not in plan_of(found) and found.count() == 5 * 320


def test_recall_is_of_the_index(spark, tmp_path, monkeypatch):
    """All vectors ask; an index that loses rows has a recall below 1."""
    _, x = vectors(spark, 320)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.recall_at_k(spark, str(tmp_path)).first().recall == 1
    got = {(r.kind, r.nprobe): r.recall for r in queries.recall_at_k_probed(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and all(0 < v < 1 for v in got.values()) and got["ivf", 1] < got["ivf", 2] < got["ivf", 3]
    build = indexes.IvfIndex.build

    def lossy(rows, *args, **options):
        index = build(rows, *args, **options)
        index.table = index.table.filter("id % 3 > 0")
        return index

    monkeypatch.setattr(indexes.IvfIndex, "build", staticmethod(lossy))
    assert queries.recall_at_k(spark, str(tmp_path)).first().recall < 0.9


@pytest.mark.parametrize("kind,options", [("hnsw", {"m": 8, "ef": 64}), ("vamana", {"degree": 16, "width": 32})])
def test_graphs(spark, tmp_path, kind, options):
    rows, x = vectors(spark, 300)
    graphs = indexes.graph_build(rows, str(tmp_path / "g"), kind, 150, "euclidean", **options)
    hits = 0
    for i in range(10):
        want = {r.id for r in knn(rows, [(0, x[i].tolist())], 10, "euclidean").collect()}
        hits += len(want & {r.id for r in indexes.graph_search(graphs, x[i].tolist(), 10, metric="euclidean").collect()})
    assert hits >= 80
    gone, delta = spark.createDataFrame([(0,)], "id bigint"), spark.createDataFrame([(999, x[0].tolist())], "id bigint, vector array<float>")
    assert indexes.graph_search(graphs, x[0].tolist(), 1, tombstones=gone, delta=delta, metric="euclidean").first().id == 999


@pytest.mark.parametrize("kind,options", [("flat_int8", {}), ("flat_float16", {"part_rows": 100}), ("ivf_flat", {"lists": 4}), ("ivf_pq", {"lists": 4, "subvectors": 4, "codes": 16}), ("hnsw", {"m": 8, "bucket_rows": 120}), ("disk_ann", {"degree": 16, "bucket_rows": 120})])
def test_indexes_by_kind(spark, tmp_path, kind, options):
    """Opened anew from disk: recall over all, and the exact result among few candidates and without excluded rows."""
    rows, x = vectors(spark, 640 if kind == "ivf_pq" else 240)
    indexes.build_index(kind, rows, f"file://{tmp_path}/i", "euclidean", **options)
    index = indexes.open_index(spark, f"file://{tmp_path}/i")
    truth = {(r.query, r.id) for r in knn(rows, [(i, x[i].tolist()) for i in range(5)], 10, "euclidean").collect()}
    assert len(truth & {(i, r.id) for i in range(5) for r in index.nearest(x[i].tolist(), 10).collect()}) >= 45
    few, gone = rows.filter("id % 40 = 3"), rows.filter("id % 40 = 3 and id < 100")
    want = [r.id for r in knn(few.filter("id >= 100"), [(0, x[3].tolist())], 5, "euclidean").collect()]
    assert [r.id for r in index.nearest(x[3].tolist(), 5, few, gone).collect()] == want
    assert {r.id for r in index.nearest(x[3].tolist(), 1, None, rows.filter("id = 3")).collect()} != {3}
    with pytest.raises(DomainError, match="index_not_found"):
        indexes.open_index(spark, f"file://{tmp_path}/none")


@pytest.mark.parametrize("kind,options", [("ivf_flat", {"lists": 2}), ("hnsw", {"m": 8})])
def test_collections_search_through_their_index(spark, catalog, kind, options):
    c = catalog.create("docs", 8, "euclidean", kind)
    rows, x = vectors(spark, 200)
    new = rows.select(F.col("id").alias("seq"), F.lit("upsert").alias("kind"), F.format_string("d%03d", "id").alias("id"), F.lit("t").alias("text"), "vector", F.lit(None).cast("map<string,struct<kind:tinyint,keys:array<string>,nums:array<double>>>").alias("metadata"))
    c.mutate(new)
    assert c._nearest(c.manifest()) is None and c.build_index(**options) >= 0.9
    ask = lambda v, **o: [r.id for r in c.search(SearchRequest(vector=v, mode="vector", limit=3, include=("scores",), **o)).collect()]
    assert c._nearest(c.manifest()) is not None and ask(x[7].tolist())[0] == "d007"
    c.mutate(batch(spark, ("delete", "d007"), ("upsert", "new", "n", (x[7] + 0.01).tolist()), ("upsert", "d008", "moved", x[9].tolist())))
    assert ask(x[7].tolist())[0] == "new" and "d007" not in ask(x[7].tolist()) and ask(x[9].tolist())[:2] == ["d008", "d009"]
    c.compact()
    assert c._nearest(c.manifest()) is None and ask(x[7].tolist())[0] == "new"
    assert c.build_index(**options) >= 0.9 and ask(x[9].tolist())[:2] == ["d008", "d009"]
    with pytest.raises(DomainError, match="index_rejected"):
        c.migrate("flat_int8", minimum_recall=1.1)
    assert c.definition.index == kind and c._nearest(c.manifest()) is not None
    c.migrate("flat_int8")
    assert catalog.get("docs").definition.index == "flat_int8" and ask(x[9].tolist())[:2] == ["d008", "d009"]
    c.rollback_index()
    assert catalog.get("docs").definition.index == kind and ask(x[9].tolist())[:2] == ["d008", "d009"]


def test_texts_are_embedded_and_files_ingested(spark, catalog, tmp_path):
    c = catalog.create("docs", 384)
    c.mutate(c.vectorised(batch(spark, ("upsert", "a", "distributed vector database"), ("upsert", "b", "cooking with garlic"))))
    assert [r.id for r in c.search(SearchRequest("a vector database", mode="vector", limit=1)).collect()] == ["a"]
    with pytest.raises(DomainError, match="dimension_mismatch"):
        catalog.create("small", 2).search(SearchRequest("x", mode="vector"))
    file = tmp_path / "files" / "note.md"
    file.parent.mkdir()
    file.write_text("\n\n".join(f"Paragraph {i} of a note. " + "It has words. " * 30 for i in range(6)))
    n = c.ingest(str(file))
    chunks = c.documents().filter("metadata['source_file'] is not null")
    assert n > 2 and chunks.count() == n and chunks.first().metadata["chunk_sequence"]["nums"] is not None
    file.write_text("Short now.")
    assert c.ingest(str(file)) == 1
    left = c.documents().filter("metadata['source_file'] is not null").collect()
    assert [r.text for r in left] == ["Short now."] and c.count() == 3


def test_events_are_signed(spark, catalog):
    import hmac

    c = catalog.create("docs", 2)
    c.mutate(batch(spark, ("upsert", "b", "x", [1.0, 0.0]), ("upsert", "a", "y", [1.0, 0.0])))
    c.mutate(batch(spark, ("delete", "a")))
    sent = streams.geo_outbox(c, "a key", 7)
    rows = sent.orderBy("sequence").collect()
    assert [(r.sequence, r.op, r.id) for r in rows] == [(8, "upsert", "a"), (9, "upsert", "b"), (10, "delete", "a")]
    for r in rows:
        fields = [str(r[f]) for f in streams.SIGNED]
        assert r.signature == hmac.new(b"a key", "".join(f"{len(f)}:{f}" for f in fields).encode(), "sha256").hexdigest()
    assert streams.verified(sent, "a key").count() == 3 and streams.verified(sent, "k" * 100).count() == 0
    assert streams.verified(sent.withColumn("content_hash", F.lit("other")), "a key").count() == 0


def test_shards_move_by_verified_steps(spark):
    schema = "id string, text string, vector array<float>, metadata map<string,struct<kind:tinyint,keys:array<string>,nums:array<double>>>, version bigint"
    frame = lambda *rows: spark.createDataFrame([(i, t, [1.0], None, v) for i, t, v in rows], schema)
    a, b, changed = frame(("x", "1", 1), ("y", "2", 1)), frame(("x", "1", 1), ("z", "9", 1)), frame(("x", "1", 1), ("y", "3", 2))
    m = placement.ShardMove("g1", "g2")
    assert {(r.id, r.kind) for r in m.advance(a, b).collect()} == {("y", "upsert"), ("z", "delete")} and m.state == "catching_up" and m.serving == "g1"
    assert m.advance(a, a) is None and m.state == "switching"
    m.advance(changed, a)  # written in between
    assert m.state == "catching_up" and m.serving == "g1"
    assert [(r.id, r.kind) for r in m.advance(changed, a).collect()] == [("y", "upsert")]
    m.advance(changed, changed), m.advance(changed, changed)
    assert m.state == "draining" and m.serving == "g2"
    m.advance(changed, changed)
    assert m.state == "active"


def test_write_queues_are_bounded():
    q = placement.WriteQueue(10, 5, 8, 4)
    assert q.offer("a", 1, "u", 4) and not q.offer("a", 1, "v", 2)
    with pytest.raises(DomainError, match="queue_saturated: collection"):
        q.offer("a", 1, "v", 2, waited_s=2.0)
    with pytest.raises(DomainError, match="queue_saturated: client"):
        q.offer("b", 2, "u", 1, waited_s=2.0)
    q.done("a", 1, "u", 4)
    assert q.offer("a", 1, "v", 2) and placement.groups_needed(1, 9, 0) == 12 and placement.groups_needed(1, 1, 100 << 30) == 4


def test_shards_move_only_for_a_tenth():
    assert placement.plan_shard_moves({"a": 100, "b": 95}) == [] and placement.plan_shard_moves({"a": 100, "b": 90}) == [("a", "b")]


def test_intervals_and_counters(spark):
    low, high = statistics.bootstrap_median([1.0, 1.1, 1.2, 1.1, 1.0] * 4)
    assert 1.0 <= low <= 1.1 <= high <= 1.2
    assert statistics.is_regression([2.0, 2.1, 2.2], [1.0, 1.1, 1.2], 0.1, 0.5) and not statistics.is_regression([1.0, 2.1, 1.2], [1.0, 1.1, 1.2], 0.1, 0.05)
    df, counters = statistics.counted(spark.range(10), "c", even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert counters.get == {"rows": 10, "even": 5}


def test_formats_by_content(spark, tmp_path):
    (tmp_path / "plain").write_text("words, without an extension")
    with zipfile.ZipFile(tmp_path / "paper", "w") as z:
        z.writestr("word/document.xml", "<w:document/>")
    got = {os.path.basename(r.path): r.format for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"plain": "text", "paper": "docx"}


@pytest.mark.parametrize("kind,options", [("hnsw", {"m": 4, "ef": 16}), ("vamana", {"degree": 8, "width": 16})])
def test_small_graphs_are_built_from_all_distances(monkeypatch, kind, options):
    """Found at once, without a call a node; the graph is that of distances found one by one."""
    x = np.random.default_rng(4).normal(size=(200, 6))
    calls, d = [], indexes.Graph.d
    monkeypatch.setattr(indexes.Graph, "d", lambda self, *a: calls.append(1) or d(self, *a))
    fast = getattr(indexes.Graph, kind)(x, list(range(200)), "cosine", **options)
    assert not calls
    monkeypatch.setattr(indexes, "WHOLE", 0, raising=False)
    slow = getattr(indexes.Graph, kind)(x, list(range(200)), "cosine", **options)
    assert len(calls) > 200 and (fast.links, fast.entry) == (slow.links, slow.entry)


def test_graph_on_a_line():
    x = np.array([[v, 0, 0] for v in range(100)], float)
    g = indexes.Graph.hnsw(x, list(range(100)), "euclidean")
    assert g.search(np.array([42.1, 0, 0]), 1, 64)[0][1] == 42


def test_index_choice():
    s = lambda **k: lifecycle.Signals(**{"vectors": 20_000, "dimension": 768, "resident_bytes": 1, "memory_bytes": 100} | k)
    small = lifecycle.Options(hnsw_minimum=1_000, ivf_minimum=5_000, pq_minimum=10_000)
    assert lifecycle.select_index(s(vectors=1_000_000, resident_bytes=200), "flat")[0] == "disk_ann"
    assert lifecycle.select_index(s(updates_per_second=2_000.0), "flat", small)[0] == "flat"
    assert "ivf_pq" != lifecycle.select_index(s(vectors=600_000, dimension=10, queries_per_second=100), "flat", small)[0]
    assert lifecycle.select_index(s(vectors=20_000, queries_per_second=2_000), "flat", small)[0] in ("ivf_flat", "hnsw")
    kind, scores = lifecycle.select_index(s(), "flat", lifecycle.Options(hysteresis=0.99))
    assert kind == "flat" and set(scores) == set(lifecycle.KINDS)


def test_generations(spark, catalog):
    catalog.create("docs", 2)
    g = lifecycle.Generations(catalog.store, "docs")
    g.activate("one", "flat", "sig1")
    g.activate("two", "ivf_flat", "sig2")
    assert g.load().active["folder"] == "two" and g.stale("sig1") and not g.stale("sig2")
    g.rollback()
    assert lifecycle.Generations(catalog.store, "docs").load().active["folder"] == "one"
    found = spark.createDataFrame([(0, 1), (0, 2)], "query bigint, id bigint")
    v = lifecycle.validate_candidate(found, found, 2, 10.0, 5.0, 2, 2)
    assert v.accepted and v.recall == 1 and v.gain == 0.5
    assert not lifecycle.validate_candidate(found.limit(1), found, 2, 10.0, 5.0, 2, 2).accepted


def test_planners():
    assert placement.plan_shard_moves({"a": 10, "b": 2, "c": 6}) == [("a", "b")]
    assert placement.plan_shard_moves({"a": 3, "b": 2}) == [] and placement.plan_shard_moves({"a": 2, "b": 9}, drain="a") == [("a", "b")]
    nodes = [placement.Node(f"n{i}", f"z{i % 2}", 100) for i in range(4)]
    assert placement.select_replicas(nodes, {"n0": 50}, 10, 3) == ["n1", "n2", "n3"]
    assert placement.select_replicas(nodes, {n.id: 75 for n in nodes}, 10) == []
    moves = placement.plan_replica_moves(nodes, {"g": (["n0", "n1", "n2"], 10)}, drain="n0")
    assert moves == [("g", "n0", "n3")]
    m = placement.MicroBatch()
    assert [m.adapt(100, 10, 0.1) for _ in range(3)] == [2, 4, 8] and m.adapt(100, 600, 0.1) == 4 and m.adapt(0, 1, 0.1) == 2


def test_fair_batch(spark):
    queue = spark.createDataFrame([("a", i, 10) for i in range(5)] + [("b", 10, 10), ("c", 11, 10)], "collection string, arrival int, bytes int")
    got = placement.fair_batch(queue, 45).orderBy("position").collect()
    assert [(r.collection, r.arrival) for r in got] == [("a", 0), ("b", 10), ("c", 11), ("a", 1)]


# Ingestion


def section(text, n=0):
    return {"sequence": n, "location": f"L{n}", "heading": f"H{n}", "text": text}


def test_chunk_bounds():
    got = chunk_sections([section(" ".join(f"concept{i}" for i in range(1, 181)))], ChunkOptions(30, 40, 6, 4))
    assert len(got) > 2 and all(c["estimated_tokens"] <= 40 for c in got) and [c["sequence"] for c in got] == list(range(len(got)))
    assert all(b["text"].split()[0] in a["text"].split() for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("o", [(7, 12, 2, 1), (20, 10, 2, 1), (20, 24, 20, 1), (20, 24, 2, 21)])
def test_chunk_options(o):
    with pytest.raises(DomainError):
        ChunkOptions(*o).validate()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c.!?;,\n'é", max_size=200), max_size=3), st.sampled_from(["recursive", "paragraph", "sentence"]))
def test_chunks_lose_no_word(texts, strategy):
    got = chunk_sections([section(t, i) for i, t in enumerate(texts)], ChunkOptions(10, 14, 3, 2, strategy))
    words = [w for t in texts for w in t.split()]
    have = "".join("".join(c["text"].split()) for c in got)
    assert all(c["text"] == c["text"].strip() and c["estimated_tokens"] == count_tokens(c["text"]) for c in got)
    assert all(w in have for w in words if count_tokens(w) <= 14)


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "guide.md").write_bytes("﻿# Title\r\n\r\nSome  text here.".encode())
    w = files.W[1:-1]
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Intro</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "in" / "a.docx").write_bytes(doc.getvalue())
    a = files.A[1:-1]
    show = io.BytesIO()
    with zipfile.ZipFile(show, "w") as z:
        for i in (10, 2):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p xmlns:a="{a}"><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p><a:p><a:r><a:t>line</a:t></a:r></a:p></p>')
    (tmp_path / "in" / "b.pptx").write_bytes(show.getvalue())
    got = {r.path.rsplit("/", 1)[1]: [(s.location, s.heading, s.text) for s in r.sections] for r in files.extract(files.read_documents(spark, str(tmp_path / "in"))).collect()}
    assert got == {"guide.md": [("Document", None, "# Title\r\n\r\nSome  text here.")], "a.docx": [("Section 1", None, "Intro"), ("Section 2", "Head", "Head\n\nBody")], "b.pptx": [("Slide 1", "Slide 2", "Slide 2\nline"), ("Slide 2", "Slide 10", "Slide 10\nline")]}
    rows = files.ingest(spark, str(tmp_path / "in"), 16)
    first = {r.id: r.vector for r in rows.collect()}
    assert first == {r.id: r.vector for r in files.ingest(spark, str(tmp_path / "in"), 16).collect()} and len(first) == 3
    assert any(k.startswith("guide:") and k.endswith(":00000") for k in first) and all(np.linalg.norm(v) == pytest.approx(1) for v in first.values())
    stale = files.stale_chunks(rows.select("document_id", "id").union(rows.select("document_id", F.concat("id", F.lit("9")))), rows)
    assert {r.id for r in stale.collect()} == {k + "9" for k in first}
    (tmp_path / "in" / "c.exe").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported_document_format"):
        files.extract(files.read_documents(spark, str(tmp_path / "in"))).collect()


def test_vector_files(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(5, 3)).astype(np.float32)
    (tmp_path / "a.fvecs").write_bytes(files.write_vecs(x))
    (tmp_path / "t.ivecs").write_bytes(files.write_vecs(np.array([[1, 2], [3, 4]], np.int32)))
    assert np.allclose([r.vector for r in files.read_vecs(spark, str(tmp_path / "a.fvecs")).orderBy("position").collect()], x)
    assert [r.ids for r in files.read_vecs(spark, str(tmp_path / "t.ivecs")).orderBy("position").collect()] == [[1, 2], [3, 4]]
    s = files.synthetic(spark, 40, 8, 4)
    assert [r.vector for r in s.orderBy("id").collect()] == [r.vector for r in s.repartition(7).orderBy("id").collect()]
    assert embed_text("").sum() == 0 and np.allclose(embed_text("a b"), embed_text("A, b"))


# Streams


def test_geo_steps():
    out, held = streams.geo_step("o", [(1, "e1", "h"), (1, "e1", "h"), (3, "e3", "h"), (1, "x", "h"), (2, "e2", "h"), (1, "e1", "other")], (1, []))
    assert [o[3] for o in out] == ["applied", "duplicate", "divergence", "divergence", "applied", "divergence"] and held[0] == 3


def test_streams(spark, tmp_path, catalog):
    src = str(tmp_path / "events")
    schema = "origin_id string, sequence bigint, event_id string, content_hash string, arrival bigint"
    rows = [("o", 1, "e1", "h", 1), ("o", 2, "e2", "h", 2), ("p", 2, "x", "h", 3), ("o", 2, "e2", "h", 4)]
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.mode("append").parquet(src)
    stream = streams.geo_inbox(spark.readStream.schema(schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("geo").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.origin_id, r.sequence, r.outcome) for r in spark.table("geo").collect()) == [("o", 1, "applied"), ("o", 2, "applied"), ("o", 2, "duplicate"), ("p", 2, "divergence")]
    c = catalog.create("docs", 2)
    log = str(tmp_path / "log")
    batch(spark, ("add", "a", "x", [1.0, 0.0]), ("update", "a", "y")).write.parquet(log)
    for _ in range(2):
        streams.upsert_stream(spark.readStream.schema(BATCH).parquet(log), c, str(tmp_path / "cp2")).awaitTermination(120)
    assert state(c) == {"a": ("y", 2)}


def test_token_buckets():
    a = streams.Admission({k: (1000.0, 1000.0) for k in ("global", "collection", "read", "write", "admin")} | {"client": (1.0, 1.0)})
    assert a.acquire("c", "read", 1, 0.0)[0]
    ok, scope, wait = a.acquire("c", "read", 1, 0.0)
    assert not ok and scope == "client" and wait == pytest.approx(1)
    assert a.acquire("c", "read", 1, 1.0)[0] and streams.request_cost(65_536) == 2
    g = streams.Admission({k: (100.0, 100.0) for k in ("client", "collection", "read", "write", "admin")} | {"global": (1.0, 10.0)})
    assert sum(g.acquire("c", "read", 1, 0.0)[0] for _ in range(20)) == 9 and g.acquire("c", "write", 1, 0.0)[0]
    r = streams.AdaptiveRate()
    assert r.update(0.6, 0) == pytest.approx(0.4) and r.update(0, 15) == pytest.approx(0.7) and r.update(1, 16) == 0.1


def test_admission_stream(spark, tmp_path):
    src = str(tmp_path / "r")
    spark.createDataFrame([("c", 1, 0.0, 1.0), ("c", 2, 0.0, 1.0), ("c", 3, 1.0, 1.0), ("d", 4, 0.0, 1.0)], "client string, request bigint, at double, cost double").coalesce(1).write.parquet(src)
    s = streams.admit_stream(spark.readStream.schema("client string, request bigint, at double, cost double").parquet(src), 1.0, 1.0)
    s.writeStream.format("memory").queryName("admit").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.request: r.accepted for r in spark.table("admit").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_entry_without_the_training_data_part(tmp_path):
    """The rest imports, and has its queries, where that folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "vectrine"), tmp_path / "vectrine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), any(n.startswith('op') for n in q))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split()[1:] == ["True", "False"] and int(out.stdout.split()[0]) > 60, out.stderr

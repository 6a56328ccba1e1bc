from __future__ import annotations

import math
from datetime import datetime
from uuid import UUID

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrine.functions import distance as dist
from vectrine.functions import filters as f
from vectrine.functions import text as tx
from vectrine.operators import bm25, fusion, sharding
from vectrine.operators.search import SearchRequest, search
from vectrine.schema import DomainError, invalid_rows, kind_of, metadata
from vectrine.sources.files import java_double, meta_from_json


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("a,b,metric,want", [([1, 0], [1, 0], "cosine", 0), ([1, 0], [-1, 0], "cosine", 2), ([0, 0], [0, 0], "cosine", 0), ([0, 0], [1, 0], "cosine", 1), ([1, 2], [3, 4], "dot", -11), (range(37), [0] * 37, "euclidean", math.sqrt(sum(i * i for i in range(37))))])
def test_distances(spark, a, b, metric, want):
    assert one(spark, dist.distance(dist.vector(a), dist.vector(b), metric))[0] == pytest.approx(want)
    assert dist.pairwise(np.array([a], float), np.array([b], float), metric)[0, 0] == pytest.approx(want)


def test_distance_needs_equal_lengths(spark):
    with pytest.raises(Exception, match="dimension_mismatch"):
        one(spark, dist.distance(dist.vector([1]), dist.vector([1, 2])))


def test_knn_orders_and_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [2.0, 0.0]), ("n", None)], "id string, vector array<float>")
    assert [r.id for r in dist.knn(rows, [(0, [1, 0])], 3, "dot").collect()] == ["c", "a", "b"]
    assert [r.id for r in dist.knn(rows, [(0, [1, 0])], 2).collect()] == ["a", "b"]
    got = dist.knn_join(rows.filter("id <> 'n'"), rows, 1, "euclidean", 2).collect()
    assert sorted((r.query, r.id) for r in got) == [("a", "a"), ("b", "a"), ("c", "c")]


@pytest.mark.parametrize("metric", dist.METRICS)
def test_screened_neighbours_are_the_exact_ones(spark, metric):
    """Single precision only rules out: with near copies far from the origin, zeros, copies and values that are no number."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(3000, 8)), 1000 + 1e-4 * rng.normal(size=(300, 8)), np.zeros((2, 8)), 1e30 * rng.normal(size=(5, 8))]).astype(np.float32).astype(float)
    x[10:20], x[40] = x[30], np.nan
    q, ids = np.concatenate([x[:60], x[3000:3030], x[3300:3302]]), rng.permutation(len(x))
    best = dist.Nearest(q, 5, metric)
    for at in range(0, len(x), 1100):
        best.rows(np.arange(len(q)), dist.Screen(x[at : at + 1100], metric), ids[at : at + 1100])
    query, found, d = best.nearest(5)
    for j in np.flatnonzero(~np.isnan(q[:, 0])):
        want = dist.pair_distances(x, np.broadcast_to(q[j], x.shape), metric)
        top = dist.nearest_rows(want, ids, 5)
        assert found[query == j].tolist() == ids[top].tolist()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:200])], "id bigint, vector array<float>")
    assert "Window" not in dist.knn_join(rows, rows, 2, metric)._jdf.queryExecution().executedPlan().toString()


def test_normalize_and_pool(spark):
    r = one(spark, dist.normalize(dist.vector([3, 4])).alias("n"), dist.normalize(dist.vector([0, 0])).alias("z"), dist.pool(F.array(dist.vector([1, 0]), dist.vector([0, 1])), F.array(F.lit(3), F.lit(4))).alias("p"))
    assert r.n == pytest.approx([0.6, 0.8]) and r.z == [0, 0] and r.p == pytest.approx([0.6, 0.8])


def test_int8_codes(spark):
    low, high = [0.0, -1.0, 5.0], [255.0, 1.0, 5.0]
    codes = one(spark, dist.encode_int8(dist.vector([12, 1, 5]), low, high).alias("c")).c
    assert codes == [12, 255, 0]
    assert one(spark, dist.decode_int8(F.array(*map(F.lit, codes)), low, high).alias("v")).v == pytest.approx([12, 1, 5])


def ranked(spark, rows, name):
    return spark.createDataFrame([(i, n + 1) for n, i in enumerate(rows)], f"id string, {name} int")


def test_rank_fusion(spark):
    got = fusion.reciprocal_rank(ranked(spark, ["a", "b"], "vector_rank"), ranked(spark, ["b", "c"], "text_rank"), 0.5, 0.5, 3).collect()
    assert [(r.id, r.vector_rank, r.text_rank) for r in got] == [("b", 2, 1), ("a", 1, None), ("c", None, 2)]
    assert [r.score for r in got] == pytest.approx([0.016261237, 0.008196721, 0.008064516], abs=1e-9)


def test_merges(spark):
    parts = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 2.0), ("c", 3.0)], "id string, score double")
    assert [(r.id, r.score) for r in fusion.merge_single(parts, 2).collect()] == [("b", 3.0), ("c", 3.0)]
    assert [r.id for r in fusion.merge_hybrid(parts, parts, 0.5, 0.5, 3).collect()] == ["b", "c", "a"]


CORPUS = [("a", "distributed vector database database"), ("b", "vector search"), ("c", "distributed systems search"), ("d", "unrelated document")]


def test_bm25(spark, tmp_path):
    docs = spark.createDataFrame(CORPUS, "id string, text string").withColumn("data_group", F.when(F.col("id") < "c", "x").otherwise("y"))
    want = {"a": pytest.approx(2.052281, abs=1e-6), "c": pytest.approx(0.668293, abs=1e-6)}
    assert {r.id: r.score for r in bm25.search(docs, "distributed database", 10).collect()} == want
    assert {r.id: r.score for r in sharding.sharded_text_topk(docs, "Distributed, DATABASE distributed", 10).collect()} == want
    stats = bm25.statistics(docs, "distributed database")
    assert (stats.documents, stats.terms, stats.frequency) == (4, 11, {"distributed": 2, "database": 1})
    assert sharding.gathered_statistics(docs, "distributed database") == stats
    index = bm25.PostingsIndex.build(docs, str(tmp_path / "p"))
    assert {r.id: r.score for r in index.search("distributed database", 10).collect()} == want
    assert [r.id for r in bm25.search(docs, "distributed database", 10, F.col("id") == "c").collect()] == ["c"]
    assert bm25.search(docs, "...", 10).collect() == [] and bm25.search(docs, "nothing", 10).collect() == []


def test_term_limit(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two three"), ("b", "one two"), ("c", None)], "id string, text string")
    assert [r.id for r in bm25.too_long(docs, 2).collect()] == ["a"]
    index = bm25.PostingsIndex.build(docs, str(tmp_path / "p"))
    with pytest.raises(DomainError, match="text_too_large"):
        index.apply(spark.createDataFrame([("a", "w " * 100_001)], "id string, text string"))
    assert (index.documents, index.terms) == (3, 5) and [r.id for r in index.search("three", 5).collect()] == ["a"]


def test_tokens_of_batches_are_those_of_the_column(spark):
    texts = ["The CAT, 12 cats. the", "", None, "naïve İstanbul ΣΑΣ ²x Ⅷ 日本語", "a_b-c d'e", "x" * 5000 + " y", "\U00030000 ok\n\nok"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: list(r.t or []) for r in df.select("id", tx.tokenize(F.col("text")).alias("t")).collect()}
    import pyarrow as pa

    for size in (1, 10, 1 << 20):
        got = {}
        for b in tx.token_blocks(pa.array(texts), size):
            for k in range(b.texts):
                got[b.first + k] = [b.lower[x:y] for x, y in zip(b.start[b.at[k] : b.at[k + 1]], b.end[b.at[k] : b.at[k + 1]])]
        assert got == want
    length, counts = tx.term_counts(pa.array(texts), ["the", "x", "ok", "none"])
    assert length.tolist() == [len(want[i]) for i in range(7)] and counts.tolist() == [[want[i].count(t) for t in ("the", "x", "ok", "none")] for i in range(7)]
    each = {(r.id, r.term): (r.tf, r.length) for r in bm25.postings(df).collect()}
    assert each == {(i, t): (ts.count(t), len(ts)) for i, ts in want.items() for t in ts}


def test_postings_are_kept_up_to_date(spark, tmp_path):
    """After every change, what a scan of the documents as they then are gives; before and after compaction."""
    rng = __import__("random").Random(3)
    now = {f"d{i:02}": " ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 9))) for i in range(40)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id string, text string")
    index = bm25.PostingsIndex.build(frame(now), str(tmp_path / "p"))
    for turn in range(4):
        gone, changed = rng.sample(sorted(now), 3), {f"d{rng.randint(0, 50):02}": "cd zz " * rng.randint(1, 3) for _ in range(5)}
        gone = [g for g in gone if g not in changed]
        index.apply(frame(changed), spark.createDataFrame([(g,) for g in gone], "id string"))
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        if turn == 2:
            index.compact()
        want = [(r.id, round(r.score, 9)) for r in bm25.search(frame(now), "cd zz ef", 50).collect()]
        assert [(r.id, round(r.score, 9)) for r in index.search("cd zz ef", 50).collect()] == want
        assert (index.documents, index.terms) == (len(now), sum(len(v.split()) for v in now.values()))
    some = spark.createDataFrame([(k,) for k in sorted(now)[:9]], "id string")
    full = {r.id: r.score for r in index.search("cd zz ef", 50).collect()}
    assert {r.id: r.score for r in index.search("cd zz ef", 50, candidates=some).collect()} == {k: pytest.approx(v) for k, v in full.items() if k in sorted(now)[:9]}


def test_postings_read_a_text_once(spark, tmp_path, monkeypatch):
    """Finding the ranges of terms doesn't count the tokens again."""
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(bm25, "postings", lambda df, plain=bm25.postings: plain(df.mapInArrow(lambda bs: (seen.add(len(b)) or b for b in bs), df.schema)))
    index = bm25.PostingsIndex.build(spark.createDataFrame([(f"d{i:03}", "the same words") for i in range(200)], "id string, text string").repartition(4), str(tmp_path / "p"))
    assert seen.value == 200 and index.documents == 200


def test_batches_are_bounded_by_bytes(spark):
    """Those of all queries: 40 texts of a megabyte are not one batch."""
    from vectrine.session import prepare_workers

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)
        rows = prepare_workers(spark).range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
        sizes = rows.mapInArrow(lambda bs: (__import__("pyarrow").RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n bigint").collect()
        assert max(r.n for r in sizes) <= 10 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_scan_reads_a_text_once(spark):
    docs = spark.createDataFrame(CORPUS, "id string, text string")
    stats = bm25.statistics(docs, "distributed database")
    plan = bm25.search(docs, "distributed database", 10, stats=stats)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan


@pytest.fixture(scope="module")
def people(spark):
    rows = [("one", "distributed vector database", [1.0, 0.0, 0.0], 2024, ["dotnet", "vector"], True), ("two", "relational database", [0.0, 1.0, 0.0], 2022, ["legacy"], None), ("three", "hybrid database search", [0.9, 0.1, 0.0], None, [], False)]
    df = spark.createDataFrame(rows, "id string, text string, vector array<float>, year int, tags array<string>, active boolean")
    return df.withColumn("metadata", metadata(year=("integral", "year"), tags=("text_array", "tags"), active=("boolean", "active"))).cache()


@pytest.mark.parametrize(
    "tree,want",
    [
        (f.both(f.gte("year", 2023), f.is_in("tags", ["vector"])), {"one"}),
        (f.negate(f.exists("active")), {"two"}),
        (f.not_equal("year", 2024), {"two", "three"}),
        (f.negate(f.gt("year", 2023)), {"two", "three"}),
        (f.equal("year", 2024.0), set()),
        (f.gt("year", 2022.5), {"one"}),
        (f.exists("tags"), {"one", "two", "three"}),
        (f.equal("tags", "vector"), {"one"}),
        (f.not_equal("tags", "vector"), {"two", "three"}),
        (f.gt("tags", 1), set()),
        (f.gt("year", "2000"), set()),
        (f.equal("active", True), {"one"}),
    ],
)
def test_filters(people, tree, want):
    promoted = {"year": ("integral", "year"), "active": ("boolean", "active")}
    for p in (None, promoted):
        assert {r.id for r in people.filter(f.compile_filter(tree, promoted=p)).collect()} == want


@pytest.mark.parametrize("bad", [f.both(f.exists("a")), f.Filter("not"), f.Filter("equal"), f.is_in("a", []), f.Filter("like", "a"), f.Filter("equal", "a", has_value=False)])
def test_bad_filters(bad):
    with pytest.raises(DomainError, match="invalid_filter"):
        f.validate(bad)


def test_filter_depth():
    tree = f.negate(f.negate(f.equal("year", 1)))
    f.validate(tree)
    with pytest.raises(DomainError, match="invalid_filter"):
        f.validate(tree, 2)


FIELDS = ("x", "y", "z")
ROWS = [(i, x, y, z) for i, (x, y, z) in enumerate([(1, 1.0, ["a"]), (None, 2.5, ["a", "b"]), (3, None, None), (None, None, []), (2, 3.0, ["b"]), (-5, 0.5, ["c", "a"])])]
leaves = st.one_of(
    st.builds(f.equal, st.sampled_from(FIELDS), st.sampled_from([1, 1.0, 2, 2.5, "a", "b"])), st.builds(f.not_equal, st.sampled_from(FIELDS), st.sampled_from([1, 3.0, "a"])),
    st.builds(f.gt, st.sampled_from(FIELDS), st.sampled_from([0, 1, 2.4, "a"])), st.builds(f.lte, st.sampled_from(FIELDS), st.sampled_from([1, 2.5])),
    st.builds(f.is_in, st.sampled_from(FIELDS), st.sampled_from([[1, "a"], [3.0], ["b", "c"]])), st.builds(f.exists, st.sampled_from(FIELDS)),
)
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(f.negate, t), st.builds(f.both, t, t), st.builds(f.either, t, t, t)), max_leaves=6)


def plain(tree, row) -> bool:
    """The rules over Python values."""
    op = tree.operator
    if op == "and":
        return all(plain(x, row) for x in tree.operands)
    if op == "or":
        return any(plain(x, row) for x in tree.operands)
    if op == "not":
        return not plain(tree.operands[0], row)
    if op == "notEqual":
        return not plain(f.equal(tree.field, tree.value), row)
    v = row[tree.field]
    if v is None:
        return False
    if op == "exists":
        return True
    scalars = v if isinstance(v, list) else [v]
    same = lambda a, b: type(a) is type(b) and a == b
    if op == "equal":
        return any(same(s, tree.value) for s in scalars)
    if op == "in":
        return any(same(s, x) for s in scalars for x in tree.values)
    if isinstance(tree.value, str):
        return False
    return any(not isinstance(s, str) and {"greaterThan": s > tree.value if not isinstance(s, str) else 0, "lessThanOrEqual": s <= tree.value if not isinstance(s, str) else 0}[op] for s in scalars)


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(trees, min_size=3, max_size=3))
def test_filters_against_a_plain_evaluator(spark, some):
    df = spark.createDataFrame(ROWS, "id int, x int, y double, z array<string>").withColumn("metadata", metadata(x=("integral", "x"), y=("number", "y"), z=("text_array", "z")))
    promoted = {"x": ("integral", "x"), "y": ("number", "y")}
    # a filter drops null as it drops false
    cols = [F.coalesce(f.compile_filter(t, promoted=p), F.lit(False)).alias(f"c{i}{'p' if p else ''}") for i, t in enumerate(some) for p in (None, promoted)]
    for r in df.select("id", *cols).collect():
        _, x, y, z = ROWS[r.id]
        for i, t in enumerate(some):
            assert r[f"c{i}"] == r[f"c{i}p"] == plain(t, {"x": x, "y": y, "z": z}), t


def test_promoted_filters_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "en"), (2, "de")], "n int, lang string").write.parquet(path)
    tree = f.both(f.equal("lang", "en"), f.gt("n", 0))
    df = spark.read.parquet(path).filter(f.compile_filter(tree, promoted={"lang": ("text", "lang"), "n": ("integral", "n")}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThan(n,0)" in plan


def test_dates_and_kinds(spark):
    assert [kind_of(x) for x in (None, True, 1, 1.5, "a", datetime(2024, 1, 1), UUID(int=1), [], [1, 2], [1, 2.0], ["a"], [True])] == ["null", "boolean", "integral", "number", "text", "datetime", "identifier", "text_array", "integral_array", "number_array", "text_array", "boolean_array"]
    for bad in ([1, "a"], {"a": 1}, float("nan"), [datetime(2024, 1, 1)]):
        with pytest.raises(DomainError):
            kind_of(bad)
    df = spark.createDataFrame([(datetime(2024, 5, 1),)], "at timestamp").withColumn("metadata", metadata(at=("datetime", "at")))
    assert df.filter(f.compile_filter(f.both(f.gt("at", datetime(2024, 4, 1)), f.equal("at", datetime(2024, 5, 1)), f.gt("at", 5)))).count() == 1


def test_json_metadata_has_the_same_keys(spark):
    df = spark.createDataFrame([('{"i": 5, "d": 42.5, "t": "x", "b": true, "n": null, "e": [], "l": [1, 2], "g": {"$guid": "6F9619FF-8B86-D011-B42D-00C04FC964FF"}, "at": {"$date": "2024-05-01T00:00:00Z"}}',)], "j string").withColumn("metadata", meta_from_json(F.col("j")))
    trees = [f.equal("i", 5), f.equal("d", 42.5), f.equal("t", "x"), f.equal("b", True), f.equal("n", None), f.exists("e"), f.equal("l", 2), f.equal("g", UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff")), f.equal("at", datetime(2024, 5, 1)), f.lt("at", datetime(2025, 1, 1))]
    assert all(df.filter(f.compile_filter(t)).count() == 1 for t in trees)
    values = [0.0, -0.0, 1.0, 1e7, 1.5e7, 123456789.25, 1e-3, 9.5e-4, 1e300, 2.5e-10, 1e16, -3.25e20, 0.1]
    assert [java_double(v) for v in values] == [r.s for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.col("v").cast("string").alias("s")).collect()]


def test_search_modes(spark, people):
    ids = lambda **k: [r.id for r in search(people, SearchRequest(**k)).collect()]
    assert ids(vector=[1, 0, 0], mode="vector", limit=2) == ["one", "three"]
    assert ids(text="database", mode="text") == ["two", "one", "three"]
    assert ids(text="database", vector=[1, 0, 0], limit=3)[0] == "one"
    assert ids(text="database", vector=[1, 0, 0], filter=f.gt("year", 2023)) == ["one"]
    assert ids(mode="metadata") == ["one", "three", "two"]
    r = search(people, SearchRequest(vector=[1, 0, 0], mode="vector", limit=1, include=("vector", "scores"))).first()
    assert r.text is None and r.metadata is None and r.vector == [1, 0, 0] and r.score == 0 and (r.vector_rank, r.text_rank) == (1, None)
    assert search(people, SearchRequest(mode="metadata", include=("text",))).first().score is None


@pytest.mark.parametrize(
    "request_,code",
    [
        (SearchRequest(mode="vector"), "vector_required"), (SearchRequest(vector=[1.0]), "text_required"), (SearchRequest(mode="metadata", limit=0), "invalid_limit"), (SearchRequest(mode="metadata", limit=1001), "invalid_limit"),
        (SearchRequest(mode="metadata", vector_weight=0, text_weight=0), "invalid_weights"), (SearchRequest(mode="metadata", vector_weight=1.5), "invalid_weights"), (SearchRequest(mode="metadata", include=("all", "x")), "invalid_include"), (SearchRequest(mode="sql"), "invalid_mode"), (SearchRequest(mode="vector", vector=[float("inf")]), "invalid_vector"),
    ],
)
def test_bad_requests(request_, code):
    with pytest.raises(DomainError, match=code):
        request_.validate()


def test_row_validation(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), (" ", [1.0, 2.0]), ("b", [1.0]), ("c", [1.0, float("nan")]), ("d", None), ("x" * 513, [1.0, 1.0])], "id string, vector array<float>").withColumn("metadata", F.lit(None).cast("map<string,struct<kind:tinyint,keys:array<string>,nums:array<double>>>"))
    assert {r.id[:2]: r.error_code for r in invalid_rows(df, 2).collect()} == {" ": "invalid_document_id", "b": "dimension_mismatch", "c": "invalid_vector", "d": "dimension_mismatch", "xx": "invalid_document_id"}


def test_text_functions(spark):
    text = "  A\r\n\r\n\r\n\r\nb\t\tc  \nd\r"
    r = one(spark, tx.normalize_text(F.lit(text)).alias("n"), tx.tokenize(F.lit("Ab-c, 12é_x")).alias("t"), tx.approximate_tokens(F.lit("it's a word12345 !? x")).alias("k"), tx.document_id(F.lit("/a/b/--My ﬁle (1).md"), F.lit("f" * 64)).alias("d"), tx.document_id(F.lit("..."), F.lit("0" * 64)).alias("e"), tx.chunk_id(F.lit("d"), F.lit(7)).alias("c"))
    assert r.n == "A\n\nb c\nd" and r.t == ["ab", "c", "12é", "x"] and r.k == 1 + 1 + 3 + 2 + 1
    assert r.d == "My-file--1:" + "f" * 16 and r.e == "document:" + "0" * 16 and r.c == "d:00007"


def test_token_windows(spark):
    w = one(spark, tx.token_windows(F.sequence(F.lit(1), F.lit(302)), 128).alias("w"), tx.token_windows(F.sequence(F.lit(1), F.lit(5)), 128).alias("s"))
    assert [len(x) - 2 for x in w.w] == [126, 126, 48] and all(x[0] == 1 and x[-1] == 302 for x in w.w)
    assert [y for x in w.w for y in x[1:-1]] == list(range(2, 302)) and w.s == [[1, 2, 3, 4, 5]]


def test_sharding(spark):
    import hashlib

    c = UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff")
    place = sharding.initial_placement(spark, c, ["b", "a", "b"])
    rows = place.collect()
    assert len(rows) == 1024 and {r.data_group for r in rows} == {"a", "b"} and rows[0].data_group != rows[1].data_group
    df = spark.createDataFrame([(str(i),) for i in range(50)], "id string")
    got = {r.id: r.shard_id for r in sharding.route(df, c, place).collect()}
    assert got == {str(i): int.from_bytes(hashlib.sha256(c.bytes_le + str(i).encode()).digest()[:4], "little") % 1024 for i in range(50)}
    moved = place.withColumn("state", F.lit("switching")).withColumn("target_group", F.lit("z"))
    assert {r.data_group for r in sharding.route(df, c, moved).collect()} == {"z"}
    two = spark.createDataFrame([("p", "g1", [10.0, 10.0]), ("q", "g2", [1.0, 1.0])], "id string, data_group string, vector array<float>")
    assert [r.id for r in sharding.sharded_vector_topk(two, [1.1, 1.1], 1, "euclidean").collect()] == ["q"]
    replicas = spark.createDataFrame([("n1", True, 5), ("n2", True, 1), ("n3", False, 0)], "node string, healthy boolean, lag int")
    assert [r.node for r in sharding.replica_order(replicas, True).orderBy("choice").collect()] == ["n2", "n1", "n3"]

"""Approximate vector indexes: scalar codes, inverted lists, product codes, and graphs by bucket.

All build from rows (id, vector) with jobs whose driver side is bounded: k-means sees a sample of TRAINING_SAMPLE rows at
most, everything else runs where the rows are, and every row is indexed. All searches rerank exactly and break ties by id.
An index on disk has a sealed description beside its rows, by which :func:`open_index` finds its kind; its search is
``nearest(vector, k, candidates, excluded)``: among candidates only, without the excluded ones (tables of ids), if given.
"""

from __future__ import annotations

import base64
import io
import json
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.functions.distance import ShortLists, calibrate, join_slices, knn, knn_join, matrix, pair_distances, pairwise, slice_rows
from vectrine.operators.store import Store
from vectrine.schema import check

#: Rows a list (or code) that training needs; below that an index stays exact.
TRAINING_FLOOR = 39
TRAINING_SAMPLE = 65_536


def halton(i: int, base: int = 2) -> float:
    f, r = 1.0, 0.0
    while i:
        f /= base
        r += f * (i % base)
        i //= base
    return r


def kmeans(x: np.ndarray, k: int, iterations: int = 12, seed: int = 17) -> np.ndarray:
    """Lloyd's centroids, the first by position, the rest drawn by squared distance along a Halton
    sequence; an empty cluster restarts at the point farthest from its own."""
    x = x.astype(np.float64)
    k = min(k, len(x))
    chosen = [x[seed % len(x)]]
    near = ((x - chosen[0]) ** 2).sum(axis=1)
    for i in range(1, k):
        total = near.cumsum()
        at = int(np.searchsorted(total, halton(seed + i) * total[-1], "right")) if total[-1] > 0 else (seed + i) % len(x)
        chosen.append(x[min(at, len(x) - 1)])
        near = np.minimum(near, ((x - chosen[-1]) ** 2).sum(axis=1))
    c = np.array(chosen)
    assigned = np.full(len(x), -1)
    for _ in range(iterations):
        d = pairwise(x, c, "euclidean")
        now = d.argmin(axis=1)
        if (now == assigned).all():
            break
        assigned = now
        for j in range(k):
            mine = assigned == j
            c[j] = x[mine].mean(axis=0) if mine.any() else x[d.min(axis=1).argmax()]
    return c


def _sample(rows: DataFrame, bound: int = TRAINING_SAMPLE) -> np.ndarray:
    """At most ``bound`` vectors, those with the least hashed ids, in the order of ids."""
    got = rows.select("id", "vector", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(bound).orderBy("id").select("vector").toPandas()
    return np.array(got.vector.tolist(), np.float64)


def prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """Unit vectors for the cosine, otherwise as they are."""
    if metric != "cosine":
        return x
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(n * n > 1e-12, x / np.where(n > 0, n, 1), x)


def state(count: int, trained: int, lists: int, codes: int = 0) -> str:
    """Untrained, collecting, active, or in need of training again at twice the rows."""
    if not count:
        return "untrained"
    if not trained:
        return "collecting" if count < TRAINING_FLOOR * max(lists, codes) else "active"
    return "needs_retrain" if count >= 2 * trained else "active"


def restrict(rows: DataFrame, candidates: DataFrame | None, excluded: DataFrame | None) -> DataFrame:
    if candidates is not None:
        rows = rows.join(candidates.select("id"), "id", "left_semi")
    return rows if excluded is None else rows.join(excluded.select("id"), "id", "left_anti")


def _floats(a: np.ndarray | None) -> str | None:
    if a is None:
        return None
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return base64.b64encode(out.getvalue()).decode()


def _array(s: str | None) -> np.ndarray | None:
    return None if s is None else np.load(io.BytesIO(base64.b64decode(s)), allow_pickle=False)


# Flat, with scalar codes


@dataclass
class CodedIndex:
    """Codes stored at build, one or two bytes a value: a search reads (id, code), and the vectors of what is short-listed
    only from the folders that have them."""

    table: DataFrame
    metric: str
    quantization: str
    parts: int
    low: np.ndarray | None = None
    scale: np.ndarray | None = None
    multiplier: int = 4

    @staticmethod
    def build(rows: DataFrame, path: str, quantization: str = "int8", metric: str = "cosine", multiplier: int = 4, part_rows: int = 1 << 20) -> "CodedIndex":
        check(quantization in ("int8", "float16"), "invalid_index_configuration", quantization)
        rows = rows.filter("vector is not null").select("id", "vector")
        parts = max(1, -(-rows.count() // part_rows))
        index = CodedIndex(rows, metric, quantization, parts, multiplier=multiplier)
        if quantization == "int8":
            c = calibrate(rows).orderBy("dim").collect()  # one row a dimension
            index.low = np.array([r.low for r in c])
            width = np.array([r.high for r in c]) - index.low
            index.scale = np.where(width > 1e-7, width / 255, 1.0)

        low, scale = index.low, index.scale

        def encode(batches):
            for b in batches:
                if len(b):
                    x = matrix(b.column(1), len(b.column(1)[0]))
                    code = np.clip(np.rint((x - low) / scale), 0, 255).astype(np.uint8) if quantization == "int8" else x.astype(np.float16)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in code], pa.binary())], ["id", "vector", "code"])

        coded = rows.mapInArrow(encode, T.StructType(list(rows.schema.fields)).add("code", T.BinaryType())).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        coded.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
        _describe(rows.sparkSession, path, {"kind": f"flat_{quantization}", "metric": metric, "parts": parts, "multiplier": multiplier, "low": _floats(index.low), "scale": _floats(index.scale)})
        return open_index(rows.sparkSession, path)

    def nearest(self, vector: Sequence[float], k: int, candidates: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
        """(id, distance): the best k * multiplier by coded distance, reranked exactly to k."""
        q, n = np.array([vector], np.float64), k * self.multiplier
        low, scale, metric, half = self.low, self.scale, self.metric, self.quantization == "float16"

        def near(batches):
            for b in batches:
                if len(b):
                    raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float16 if half else np.uint8).reshape(len(b), -1).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pairwise(raw if half else low + raw * scale, q, metric)[:, 0])], ["id", "near"])

        codes = restrict(self.table.select("id", "code"), candidates, excluded)
        short = codes.mapInArrow(near, T.StructType().add(self.table.schema["id"]).add("near", T.DoubleType())).orderBy("near", "id").limit(n)
        ids = [r.id for r in short.collect()]  # k * multiplier at most
        if not ids:
            return self.table.select("id", F.lit(0.0).alias("distance")).limit(0)
        one = self.table.sparkSession.createDataFrame([(i,) for i in ids], T.StructType().add(self.table.schema["id"]))
        folders = [r[0] for r in one.select(F.pmod(F.xxhash64("id"), F.lit(self.parts))).distinct().collect()]
        rows = self.table.filter(F.col("part").isin(folders) & F.col("id").isin(ids))
        return knn(rows, [(0, vector)], k, self.metric).select("id", "distance")


# Inverted lists


def _code_steps(books: Sequence[np.ndarray], most: int = 512) -> list[range]:
    """Books whose codes are looked up together, so that a table has ``most`` entries at most."""
    out, at, size = [], 0, 1
    for s, book in enumerate(books):
        if s > at and size * len(book) > most:
            out.append(range(at, s))
            at, size = s, 1
        size *= len(book)
    return [*out, range(at, len(books))]


def _code_place(books: Sequence[np.ndarray], step: range, code: np.ndarray) -> np.ndarray:
    """Where the codes of ``step`` stand in its table."""
    place = np.zeros(len(code), np.int64)
    for s in step:
        place = place * len(books[s]) + code[:, s]
    return place


def _code_tables(books: Sequence[np.ndarray], steps: Sequence[range], rest: np.ndarray) -> list[np.ndarray]:
    """Of residuals of queries, the squared distances to all codes of each step: a row a query."""
    parts, out = np.split(rest, len(books), axis=1), []
    for step in steps:
        table = np.zeros((len(rest), 1))
        for s in step:
            table = (table[:, :, None] + ((parts[s][:, None] - books[s][None]) ** 2).sum(axis=2)[:, None]).reshape(len(rest), -1)
        out.append(table)
    return out


def _code_distances(tables: Sequence[np.ndarray], places: Sequence[np.ndarray]) -> np.ndarray:
    near = tables[0].take(places[0])
    for table, place in zip(tables[1:], places[1:]):
        near += table.take(place)
    return near


@dataclass
class IvfIndex:
    """Lists by nearest centroid: ``table`` has (id, vector, list_id), partitioned by list_id on disk."""

    table: DataFrame
    centroids: np.ndarray | None
    metric: str
    trained: int
    books: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def build(rows: DataFrame, path: str, lists: int = 256, metric: str = "cosine", iterations: int = 12, subvectors: int = 0, codes: int = 256) -> "IvfIndex":
        """With ``subvectors`` it has product codes of the residuals too. Below the training floor it is exact."""
        rows = rows.filter("vector is not null").select("id", "vector")
        n = rows.count()
        if n < TRAINING_FLOOR * max(lists, codes if subvectors else 0):
            rows.withColumn("list_id", F.lit(0)).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
            _describe(rows.sparkSession, path, {"kind": "ivf_pq" if subvectors else "ivf_flat", "metric": metric, "trained": 0, "centroids": None, "books": []})
            return open_index(rows.sparkSession, path)
        x = prepared(_sample(rows), metric)
        check(not subvectors or x.shape[1] % subvectors == 0, "invalid_index_configuration", "dimension % subvectors")
        c = kmeans(x, lists, iterations, 29 if subvectors else 17)
        books = []
        if subvectors:
            rest = x - c[pairwise(x, c, "euclidean").argmin(axis=1)]
            books = [kmeans(part, codes, iterations, 41 + s) for s, part in enumerate(np.split(rest, subvectors, axis=1))]

        def assign(batches):
            for b in batches:
                if not len(b):
                    continue
                v = prepared(matrix(b.column(1), c.shape[1]), metric)
                own = pairwise(v, c, "euclidean").argmin(axis=1)
                cols = [b.column(0), b.column(1), pa.array(own.astype(np.int32))]
                if books:
                    code = [pairwise(p, k, "euclidean").argmin(axis=1).astype(np.uint8) for p, k in zip(np.split(v - c[own], len(books), axis=1), books)]
                    cols.append(pa.array([bytes(r) for r in np.stack(code, axis=1)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "vector", "list_id", "code"][: len(cols)])

        schema = T.StructType(list(rows.schema.fields)).add("list_id", T.IntegerType())
        if books:
            schema = schema.add("code", T.BinaryType())
        # rebalanced by size, so that a list that holds most rows is several tasks' and files'
        rows.mapInArrow(assign, schema).hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
        _describe(rows.sparkSession, path, {"kind": "ivf_pq" if books else "ivf_flat", "metric": metric, "trained": n, "centroids": _floats(c), "books": [_floats(b) for b in books]})
        return open_index(rows.sparkSession, path)

    def probes(self, query: Sequence[float], nprobe: int) -> list[int]:
        q = prepared(np.array([query], np.float64), self.metric)
        d = ((self.centroids - q) ** 2).sum(axis=1)
        return [int(i) for i in np.lexsort((np.arange(len(d)), d))[:nprobe]]

    def nearest(self, vector: Sequence[float], k: int, candidates: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
        return self.search(vector, k, candidates=candidates, excluded=excluded)

    def search(self, query: Sequence[float], k: int, nprobe: int = 8, rerank: int = 8, candidates: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
        """(id, distance). Only the probed lists' folders are read. Few candidates (eight times k, or as many as there are
        lists) are all compared, in whatever list."""
        rows = restrict(self.table, candidates, excluded)
        few = candidates is not None and self.centroids is not None and candidates.limit((most := max(8 * k, len(self.centroids))) + 1).count() <= most
        if self.centroids is None or few:
            return knn(rows, [(0, query)], k, self.metric).select("id", "distance")
        rows = rows.filter(F.col("list_id").isin(self.probes(query, nprobe)))
        if self.books:
            rows = self._short(rows, query, k * rerank)
        return knn(rows, [(0, query)], k, self.metric).select("id", "distance")

    def search_join(self, queries: DataFrame, k: int, nprobe: int = 8, rerank: int = 8, block_rows: int = 16_384) -> DataFrame:
        """(query, id, distance): :meth:`search` of every row of a table ``queries`` (id, vector), as a join on the list.

        Queries of the same first list are cut by hash into slices, of ``block_rows`` at most and fewer where short lists are long; a task has
        one slice, by which the rows of the lists that it probes go in batches. No short list leaves its task."""
        queries = queries.filter("vector is not null").select(F.col("id").alias("query"), "vector")
        if self.centroids is None:
            return knn_join(queries.withColumnRenamed("query", "id"), self.table, k, self.metric)
        c, books, metric = self.centroids, self.books, self.metric
        n = k * rerank if books else k

        def probed(batches):
            for b in batches:
                if not len(b):
                    continue
                d = ((prepared(matrix(b.column(1), c.shape[1]), metric)[:, None] - c[None]) ** 2).sum(axis=2)
                lists = d.argsort(axis=1, kind="stable")[:, :nprobe].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists.tolist(), pa.list_(pa.int32()))], ["query", "vector", "lists"])

        def coded(nearest: ShortLists, some: np.ndarray, one: int, batch: pa.RecordBatch, x: np.ndarray, ids: np.ndarray) -> None:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            steps = _code_steps(books)
            places = [_code_place(books, step, code) for step in steps]
            tables = _code_tables(books, steps, prepared(nearest.q[some], metric) - c[one])
            for i, j in enumerate(some.tolist()):
                near = _code_distances([t[i] for t in tables], places)
                bound = nearest.cut[j]
                if np.isinf(bound) and len(near) > n:
                    bound = np.partition(near, n - 1)[n - 1]
                few = np.flatnonzero(~(near > bound))
                if len(few):
                    nearest.extend(j, ids[few], near[few], pair_distances(x[few], nearest.q[j : j + 1], metric))

        lists = queries.mapInArrow(probed, T.StructType(list(queries.schema.fields)).add("lists", T.ArrayType(T.IntegerType())))
        first = F.element_at("lists", 1)
        most = lists.groupBy(first).count().agg(F.max("count")).first()[0] or 0
        busy = 2 * queries.sparkSession.sparkContext.defaultParallelism
        cuts = max(1, -(-most // slice_rows(n, block_rows)), min(-(-busy // len(c)), -(-most // 256)))
        asked = lists.withColumn("s", (first * cuts + F.pmod(F.xxhash64("query"), F.lit(cuts))).cast("int"))
        # at most a number for each list and slice
        to = asked.select(F.explode("lists").alias("list_id"), "s").groupBy("list_id").agg(F.collect_set("s").alias("to"))
        held = self.table.join(F.broadcast(to), "list_id").withColumn("s", F.explode("to"))
        held = held.select("id", "vector", F.col("list_id").cast("int").alias("list_id"), "s", *["code"] * bool(books))
        return join_slices(asked, held, len(c) * cuts, k, n, metric, coded if books else None)

    def _short(self, rows: DataFrame, query: Sequence[float], n: int) -> DataFrame:
        """The best n by asymmetric distance of the codes."""
        q = prepared(np.array([query], np.float64), self.metric)[0]
        c, books = self.centroids, self.books

        def near(batches):
            for b in batches:
                if not len(b):
                    continue
                own, code = b.column("list_id").to_numpy(), np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(b), -1)
                d, steps = np.zeros(len(b)), _code_steps(books)
                for i in np.unique(own):
                    mine = own == i
                    d[mine] = _code_distances([t[0] for t in _code_tables(books, steps, (q - c[i])[None])], [_code_place(books, step, code[mine]) for step in steps])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(d)], ["id", "vector", "near"])

        schema = T.StructType([f for f in rows.schema.fields if f.name in ("id", "vector")]).add("near", T.DoubleType())
        return rows.select("id", "vector", "list_id", "code").mapInArrow(near, schema).orderBy("near", "id").limit(n)


# Graphs


def hnsw_level(id_: str, m: int, most: int = 32) -> int:
    """Level of an id by its hash, so that a rebuild gives the same graph."""
    u = int.from_bytes(hashlib.sha256(str(id_).encode()).digest()[:8], "little") / 2.0**64
    return min(most, int(-np.log(max(u, 1e-18)) / np.log(max(m, 2))))


#: Rows of a bucket at most whose distances are all found at once, before its graph is built.
WHOLE = 1536


class Graph:
    """A proximity graph of one bucket's vectors: adjacency by level, an entry point."""

    def __init__(self, x: np.ndarray, ids: list, metric: str) -> None:
        self.x, self.ids, self.metric = x, ids, metric
        self.links: list[dict[int, list[int]]] = [{}]
        self.entry = -1
        self.all: list[list[float]] | None = None

    def compare_all(self) -> None:
        """For building: the distances of a small bucket, as numbers that need no call each."""
        if len(self.x) <= WHOLE:
            self.all = pairwise(self.x, self.x, self.metric).tolist()

    def near(self, i: int, nodes: Sequence[int]) -> list[float]:
        """Distances of nodes to node i."""
        if self.all is None:
            return self.d(self.x[i], nodes).tolist()
        row = self.all[i]
        return [row[v] for v in nodes]

    def d(self, q: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
        return pairwise(self.x[list(nodes)], q[None], self.metric)[:, 0]

    def beam(self, q: np.ndarray | int, start: int, width: int, level: int = 0) -> list[tuple[float, int]]:
        """Best-first search from a vector or a node: the ``width`` nearest nodes that it meets, and their distances."""
        import heapq

        of = self.near if isinstance(q, int) else lambda v, nodes: self.d(v, nodes).tolist()
        seen, first = {start}, of(q, [start])[0]
        todo, best = [(first, start)], [(-first, -start)]
        while todo:
            d, n = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [v for v in self.links[level].get(n, ()) if v not in seen]
            if not new:
                continue
            seen.update(new)
            for dv, v in zip(of(q, new), new):
                if len(best) < width or dv < -best[0][0]:
                    heapq.heappush(todo, (dv, v))
                    heapq.heappush(best, (-dv, -v))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    @staticmethod
    def hnsw(x: np.ndarray, ids: list, metric: str, m: int = 16, ef: int = 128) -> "Graph":
        g = Graph(x, ids, metric)
        g.compare_all()
        top = -1
        for i in np.argsort(np.array([str(v) for v in ids]), kind="stable"):
            i = int(i)
            level = hnsw_level(ids[i], m)
            while len(g.links) <= level:
                g.links.append({})
            for a in range(level + 1):
                g.links[a][i] = []
            at = g.entry
            if at >= 0:
                for a in range(top, level, -1):
                    at = g.beam(i, at, 1, a)[0][1]
                for a in range(min(top, level), -1, -1):
                    near = [(d, n) for d, n in g.beam(i, at, ef, a) if n != i]
                    at = near[0][1]
                    most = 2 * m if a == 0 else m
                    g.links[a][i] = [n for _, n in near[:m]]
                    for n in g.links[a][i]:
                        back = g.links[a][n]
                        back.append(i)
                        if len(back) > most:
                            g.links[a][n] = [v for _, v in sorted(zip(g.near(n, back), back), key=lambda p: p[0])[:most]]
            if level > top:
                top, g.entry = level, i
        g.all = None
        return g

    @staticmethod
    def vamana(x: np.ndarray, ids: list, metric: str, degree: int = 32, width: int = 64, alpha: float = 1.2) -> "Graph":
        g = Graph(x, ids, metric)
        g.compare_all()
        n = len(x)
        order = [int(i) for i in np.argsort([hashlib.sha256(str(v).encode()).hexdigest() for v in ids], kind="stable")]
        g.links[0] = {i: [j for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)}
        some = x[order[: min(n, 256)]]
        g.entry = int(pairwise(x, some, metric).sum(axis=1).argmin()) if n else -1
        for turn in (order, order[::-1]):
            for i in turn:
                g.links[0][i] = g._prune(i, [v for _, v in g.beam(i, g.entry, width)] + g.links[0][i], degree, alpha)
                for j in g.links[0][i]:
                    if i not in g.links[0][j]:
                        g.links[0][j].append(i)
                        if len(g.links[0][j]) > degree:
                            g.links[0][j] = g._prune(j, g.links[0][j], degree, alpha)
        g.all = None
        return g

    def _prune(self, i: int, nodes: list[int], degree: int, alpha: float) -> list[int]:
        nodes = sorted(set(nodes) - {i})
        if not nodes:
            return []
        dist = dict(zip(nodes, self.near(i, nodes)))
        left = sorted(nodes, key=dist.__getitem__)
        out: list[int] = []
        while left and len(out) < degree:
            p = left.pop(0)
            out.append(p)
            if left:
                away = self.near(p, left)
                left = [v for v, a in zip(left, away) if alpha * a > dist[v]]
        return out

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, object]]:
        if self.entry < 0:
            return []
        at = self.entry
        for a in range(len(self.links) - 1, 0, -1):
            if at in self.links[a]:
                at = self.beam(q, at, 1, a)[0][1]
        return [(d, self.ids[n]) for d, n in self.beam(q, at, max(width, 4 * k))][:k]


#: Of the form of a stored graph.
GRAPH_FORMAT = 1


def graph_bytes(g: Graph) -> bytes:
    """An archive of arrays: vectors, ids as JSON, and for each level its nodes, offsets and neighbours."""
    out, levels = io.BytesIO(), {}
    for a, links in enumerate(g.links):
        levels[f"nodes{a}"] = np.array(list(links), np.int64)
        levels[f"offsets{a}"] = np.cumsum([0] + [len(v) for v in links.values()])
        levels[f"links{a}"] = np.array([n for v in links.values() for n in v], np.int64)
    head = json.dumps({"format": GRAPH_FORMAT, "metric": g.metric, "entry": g.entry, "levels": len(g.links), "ids": [v.item() if isinstance(v, np.generic) else v for v in g.ids]})
    np.savez_compressed(out, head=np.frombuffer(head.encode(), np.uint8), x=g.x, **levels)
    return out.getvalue()


def graph_of(data: bytes) -> Graph:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        head = json.loads(z["head"].tobytes())
        check(head["format"] == GRAPH_FORMAT, "index_corrupted", f"format {head['format']}")
        g = Graph(z["x"], head["ids"], head["metric"])
        g.entry = head["entry"]
        g.links = []
        for a in range(head["levels"]):
            at, links = z[f"offsets{a}"], z[f"links{a}"].tolist()
            g.links.append({int(n): links[at[i] : at[i + 1]] for i, n in enumerate(z[f"nodes{a}"])})
    return g


def graph_build(rows: DataFrame, path: str, kind: str = "hnsw", bucket_rows: int = 20_000, metric: str = "cosine", **options) -> DataFrame:
    """Write (bucket, graph) of every bucket of about ``bucket_rows`` rows: inserting is sequential, so
    each bucket has its own graph, built side by side, and a search asks all of them."""
    n = max(1, -(-rows.count() // bucket_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.array(pdf.vector.tolist(), np.float64)
        g = (Graph.hnsw if kind == "hnsw" else Graph.vamana)(x, pdf.id.tolist(), metric, **options)
        return pd.DataFrame({"bucket": [int(pdf.bucket.iloc[0])], "graph": [graph_bytes(g)]})

    bucketed = rows.filter("vector is not null").select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("bucket"))
    # a task each, as the work is out of proportion to the bytes by which tasks would be put together
    bucketed.repartitionById(n, F.col("bucket")).groupBy("bucket").applyInPandas(build, "bucket int, graph binary").write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def graph_search(graphs: DataFrame, query: Sequence[float], k: int, width: int = 64, tombstones: DataFrame | None = None, delta: DataFrame | None = None, metric: str = "cosine", id_type: str = "bigint") -> DataFrame:
    """(id, distance): top k of all buckets' graphs, without deleted ids, and of ``delta`` (id, vector), which is scanned."""
    q = np.array(query, np.float64)

    def run(batches):
        for b in batches:
            hits = [h for blob in b.column(0) for h in graph_of(blob.as_py()).search(q, k, width)]
            yield pa.RecordBatch.from_arrays([pa.array([h[1] for h in hits], pa.int64() if id_type == "bigint" else pa.string()), pa.array([float(h[0]) for h in hits], pa.float64())], ["id", "distance"])

    hits = graphs.select("graph").mapInArrow(run, f"id {id_type}, distance double")
    if delta is not None:
        hits = hits.join(delta.select("id"), "id", "left_anti").unionByName(knn(delta, [(0, query)], k, metric).select("id", "distance"))
    if tombstones is not None:
        hits = hits.join(tombstones.select("id"), "id", "left_anti")
    return hits.orderBy("distance", "id").limit(k)


@dataclass
class GraphIndex:
    """Graphs of all buckets, and the rows beside them for what a graph can't tell."""

    graphs: DataFrame
    table: DataFrame
    metric: str
    width: int

    @staticmethod
    def build(rows: DataFrame, path: str, kind: str = "hnsw", metric: str = "cosine", bucket_rows: int = 20_000, width: int = 64, **options) -> "GraphIndex":
        rows = rows.filter("vector is not null").select("id", "vector")
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        graph_build(rows.sparkSession.read.parquet(f"{path}/rows"), f"{path}/graphs", "hnsw" if kind == "hnsw" else "vamana", bucket_rows, metric, **options)
        _describe(rows.sparkSession, path, {"kind": kind, "metric": metric, "width": width})
        return open_index(rows.sparkSession, path)

    def nearest(self, vector: Sequence[float], k: int, candidates: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
        """(id, distance). A graph is asked for four times k; where candidates or exclusions leave fewer than k of those,
        the rows are compared instead."""
        id_type = self.table.schema["id"].dataType.simpleString()
        many = k if candidates is None and excluded is None else 4 * k
        hits = restrict(graph_search(self.graphs, vector, many, max(self.width, many), metric=self.metric, id_type=id_type), candidates, excluded).orderBy("distance", "id").limit(k)
        if many > k:
            got = hits.collect()  # k at most
            if len(got) < k:
                return knn(restrict(self.table, candidates, excluded), [(0, vector)], k, self.metric).select("id", "distance")
            return self.table.sparkSession.createDataFrame(got, hits.schema)
        return hits


# By kind

BUILDERS = {
    "flat_int8": lambda rows, path, metric, **o: CodedIndex.build(rows, path, "int8", metric, **o),
    "flat_float16": lambda rows, path, metric, **o: CodedIndex.build(rows, path, "float16", metric, **o),
    "ivf_flat": lambda rows, path, metric, **o: IvfIndex.build(rows, path, metric=metric, **o),
    "ivf_pq": lambda rows, path, metric, **o: IvfIndex.build(rows, path, metric=metric, **({"subvectors": 8} | o)),
    "hnsw": lambda rows, path, metric, **o: GraphIndex.build(rows, path, "hnsw", metric, **o),
    "disk_ann": lambda rows, path, metric, **o: GraphIndex.build(rows, path, "disk_ann", metric, **o),
}
INDEX_FORMAT = 1


def build_index(kind: str, rows: DataFrame, path: str, metric: str = "cosine", **options):
    check(kind in BUILDERS, "invalid_index_configuration", kind)
    return BUILDERS[kind](rows, path, metric, **options)


def _describe(spark, path: str, what: dict) -> None:
    store = Store(spark, path)
    found = store.latest("description")
    store.commit("description", found[0] if found else 0, {"format": INDEX_FORMAT} | what)


def open_index(spark, path: str):
    """An index that was built at ``path``."""
    found = Store(spark, path).latest("description")
    check(found is not None, "index_not_found", path)
    d = found[1]
    check(d["format"] == INDEX_FORMAT, "index_corrupted", f"format {d['format']}")
    table = spark.read.parquet(f"{path}/rows")
    if d["kind"].startswith("ivf"):
        return IvfIndex(table, _array(d["centroids"]), d["metric"], d["trained"], [_array(b) for b in d["books"]])
    if d["kind"].startswith("flat"):
        return CodedIndex(table, d["metric"], d["kind"].removeprefix("flat_"), d["parts"], _array(d["low"]), _array(d["scale"]), d["multiplier"])
    return GraphIndex(spark.read.parquet(f"{path}/graphs"), table, d["metric"], d["width"])

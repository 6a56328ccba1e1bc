"""Vector distances: as Columns for small or composed use, and as an Arrow kernel for scans.

All are computed in double. The kernel reads the flat child buffer of the array column, so a
batch is one matrix product, and keeps only the k nearest rows of its partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.schema import check

METRICS = ("cosine", "dot", "euclidean")
#: Share of both vectors' squared lengths below which a squared distance is taken from differences: above it, the sum of
#: squares has twelve digits at least.
NEAR = 1e-3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    na, nb = dot(a, a), dot(b, b)
    inner = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(na * nb)))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(1.0 - inner)


def squared_euclidean(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Distance of two vector columns; raises where their lengths differ or are zero."""
    check(metric in METRICS, "invalid_metric", metric)
    d = {"cosine": cosine_distance, "dot": lambda x, y: -dot(x, y), "euclidean": lambda x, y: F.sqrt(squared_euclidean(x, y))}[metric](a, b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), d).otherwise(F.raise_error(F.lit("dimension_mismatch")).cast("double"))


def normalize(v: Column) -> Column:
    """Unit length; (near) zero vectors as they are."""
    n = dot(v, v)
    return F.when(n <= 1e-12, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / F.sqrt(n)))


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Float matrix of a list column without nulls; raises ``dimension_mismatch``."""
    offsets = column.offsets.to_numpy()
    check(bool((np.diff(offsets) == dimension).all()), "dimension_mismatch")
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, dimension).astype(np.float64)


def pairwise(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every row of x to every row of q. Euclidean ones are of the sum of squares, which cancels for near
    vectors; those are found anew from differences."""
    inner = x @ q.T
    if metric == "dot":
        return -inner
    nx, nq = np.einsum("ij,ij->i", x, x)[:, None], np.einsum("ij,ij->i", q, q)[None]
    if metric == "euclidean":
        square, scale = nx + nq - 2 * inner, nx + nq
        i, j = np.nonzero(square < NEAR * scale)
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            square[a, b] = ((x[a] - q[b]) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(square, 0))
    zero = (nx == 0) | (nq == 0)
    return np.where(zero, np.where((nx == 0) & (nq == 0), 0.0, 1.0), 1 - np.clip(inner / np.sqrt(np.where(zero, 1, nx * nq)), -1, 1))


def nearest_rows(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k least distances, ties by id."""
    if len(d) > k:
        cut = np.partition(d, k - 1)[k - 1]
        some = np.flatnonzero(d <= cut)
    else:
        some = np.arange(len(d))
    return some[np.lexsort((ids[some], d[some]))][:k]


def knn(rows: DataFrame, queries: Sequence[tuple[object, Sequence[float]]], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query, id, distance): the k nearest rows of each query, ties by id.

    Every task keeps k rows a query, and the merge sorts those only. ``queries`` travel in the closure:
    they are the request, a bounded list; for a table of queries see :func:`knn_join`.
    """
    check(metric in METRICS, "invalid_metric", metric)
    check(k >= 1, "invalid_limit")
    q = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    names = [n for n, _ in queries]
    kind = rows.schema[id_col].dataType
    name_type = "bigint" if all(isinstance(n, int) for n in names) else "string"
    schema = T.StructType().add("query", T.LongType() if name_type == "bigint" else T.StringType()).add("id", kind).add("distance", T.DoubleType())

    def local(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, object), np.zeros(0)) for _ in names]
        for batch in batches:
            if not len(batch):
                continue
            d = pairwise(matrix(batch.column(1), q.shape[1]), q, metric)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for j in range(len(names)):
                all_ids, all_d = np.concatenate([best[j][0], ids]), np.concatenate([best[j][1], d[:, j]])
                top = nearest_rows(all_d, all_ids, k)
                best[j] = all_ids[top], all_d[top]
        for n, (ids, d) in zip(names, best):
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(d), pa.int64() if name_type == "bigint" else pa.string()), pa.array(ids.tolist(), batch_type), pa.array(d)], ["query", "id", "distance"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(kind)
    part = rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(local, schema)
    from pyspark.sql import Window

    line = Window.partitionBy("query").orderBy("distance", "id")
    if len(names) == 1:
        return part.orderBy("distance", "id").limit(k)
    return part.withColumn("rn", F.row_number().over(line)).filter(F.col("rn") <= k).drop("rn")


#: Queries that are compared with a batch of rows at once.
TOGETHER = 256
#: Bytes that a task's short lists may take.
SHORTLISTS = 192 << 20


def firsts(n: int, query: np.ndarray, by: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indices of the n rows of each query that are first by (``by``, id), query by query."""
    order = np.lexsort((ids, by, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q, "left") < n]


def pair_distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """:func:`pairwise` of rows of the same number."""
    if metric == "euclidean":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    inner = np.einsum("ij,ij->i", x, q)
    if metric == "dot":
        return -inner
    nx, nq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    zero = (nx == 0) | (nq == 0)
    return np.where(zero, np.where((nx == 0) & (nq == 0), 0.0, 1.0), 1 - np.clip(inner / np.sqrt(np.where(zero, 1, nx * nq)), -1, 1))


class Screen:
    """A batch of rows, to be compared with queries in single precision first: what may be among the nearest by the bound of
    its error is found anew in double. Cosines are of unit vectors, other values of at most 1."""

    def __init__(self, x: np.ndarray, metric: str) -> None:
        self.x, self.metric, self.unit = x, metric, 1.0
        if metric == "cosine":
            n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            z = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        else:
            self.unit = float(np.abs(x).max(initial=0)) or 1.0
            z = x / self.unit
        square = np.einsum("ij,ij->i", z, z)
        self.length = float(np.sqrt(square.max(initial=0)))
        self.single = (np.hstack([z, square[:, None]]) if metric == "euclidean" else z).astype(np.float32)

    def candidates(self, q: np.ndarray, n: int, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs that may be among the n nearest of these rows and at most ``cut`` away. What is no number passes."""
        nq = np.sqrt(np.einsum("ij,ij->i", q, q))
        with np.errstate(all="ignore"):
            if self.metric == "cosine":
                y, bound, size = -np.divide(q, nq[:, None], out=np.zeros_like(q), where=nq[:, None] > 0), cut - 1, np.ones(len(q))
            elif self.metric == "dot":
                y, bound, size = -q / self.unit, cut / self.unit**2, self.length * nq / self.unit
            else:
                y = np.hstack([-2 * q / self.unit, np.ones((len(q), 1))])
                bound, size = (cut**2 - nq**2) / self.unit**2, self.length**2 + 2 * self.length * nq / self.unit + (nq / self.unit) ** 2 * 1e-6
            error = (self.x.shape[1] + 16) * 1.2e-7 * size + 1e-30
            s = y.astype(np.float32) @ self.single.T
            bound = bound + error
            some = min(s.shape[1] // 16, max(64, 8 * n))
            if some >= n and np.isinf(cut).any():  # the least of each of n groups are n rows
                least = s[:, : s.shape[1] // some * some].reshape(len(s), -1, some).min(axis=1)
                bound = np.fmin(bound, np.partition(least, n - 1, axis=1)[:, n - 1] + 2 * error)
            bound = np.nextafter(bound.astype(np.float32), np.float32(np.inf))
            found = ~(s > bound[:, None])
        zero = nq == 0
        if self.metric == "cosine" and zero.any():  # two zero vectors are no distance apart
            found[zero] = True
        return np.nonzero(found)


class Nearest:
    """Of a few queries, the ``n`` rows each with the least (near, id), of rows that come in batches; and, in the end, the k of those
    with the least (distance, id). Held are half as many again at most, and what one batch adds."""

    def __init__(self, q: np.ndarray, n: int, metric: str) -> None:
        self.q, self.n, self.metric = q, n, metric
        self.cut = np.full(len(q), np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, query: np.ndarray, ids: np.ndarray, near: np.ndarray, distance: np.ndarray) -> None:
        if len(query):
            self.parts.append((query.astype(np.int32), ids, near, distance))
            self.size += len(query)
            if self.size > 1.5 * self.n * len(self.q):
                self.merge()

    def merge(self) -> None:
        query, ids, near, distance = (np.concatenate(p) for p in zip(*self.parts))
        keep = firsts(self.n, query, near, ids)
        query, near = query[keep], near[keep]
        self.parts, self.size = [(query, ids[keep], near, distance[keep])], len(keep)
        last = np.searchsorted(query, np.arange(len(self.q)), "right") - 1
        full = np.bincount(query, minlength=len(self.q)) == self.n
        self.cut[full] = near[last[full]]

    def rows(self, some: np.ndarray, screen: Screen, ids: np.ndarray) -> None:
        """Compare a batch with the queries ``some``."""
        at, row = screen.candidates(self.q[some], self.n, self.cut[some])
        query = some[at]
        d = np.empty(len(row))
        for a in range(0, len(row), 1 << 14):
            part = slice(a, a + (1 << 14))
            d[part] = pair_distances(screen.x[row[part]], self.q[query[part]], self.metric)
        few = ~(d > self.cut[query])
        self.add(query[few], ids[row[few]], d[few], d[few])
        if self.size and self.n < 64:
            self.merge()

    def nearest(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance)"""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.merge()
        query, ids, _, d = self.parts[0]
        keep = firsts(k, query, d, ids)
        return query[keep], ids[keep], d[keep]


class ShortLists(Nearest):
    """:class:`Nearest` where n is large: each query's list is kept by itself."""

    def __init__(self, q: np.ndarray, n: int, metric: str) -> None:
        super().__init__(q, n, metric)
        self.own: list[list[tuple[np.ndarray, ...]]] = [[] for _ in q]
        self.held = np.zeros(len(q), np.int64)

    def extend(self, j: int, ids: np.ndarray, near: np.ndarray, distance: np.ndarray) -> None:
        self.own[j].append((ids, near, distance))
        self.held[j] += len(ids)
        if self.held[j] > 1.5 * self.n:
            self.trim(j)

    def trim(self, j: int) -> None:
        ids, near, distance = (np.concatenate(p) for p in zip(*self.own[j]))
        if len(ids) >= self.n:
            keep = nearest_rows(near, ids, self.n) if np.isnan(near).any() else self._least(near, ids)
            ids, near, distance = ids[keep], near[keep], distance[keep]
            self.cut[j] = near.max()
        self.own[j], self.held[j] = [(ids, near, distance)], len(ids)

    def _least(self, near: np.ndarray, ids: np.ndarray) -> np.ndarray:
        cut = np.partition(near, self.n - 1)[self.n - 1]
        less, ties = np.flatnonzero(near < cut), np.flatnonzero(near == cut)
        return np.concatenate([less, ties[np.argsort(ids[ties], kind="stable")][: self.n - len(less)]])

    def nearest(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out: list[tuple[np.ndarray, ...]] = []
        for j in np.flatnonzero(self.held):
            self.trim(j)
            ids, _, d = self.own[j][0]
            top = nearest_rows(d, ids, k)
            out.append((np.full(len(top), j), ids[top], d[top]))
        return tuple(np.concatenate(p) for p in zip(*out)) if out else super().nearest(k)


def slice_rows(n: int, most: int) -> int:
    """Queries of a task whose short lists have n rows."""
    return max(TOGETHER, min(most, SHORTLISTS // (32 * n)))


def join_slices(asked: DataFrame, held: DataFrame, slices: int, k: int, n: int, metric: str, compare=None) -> DataFrame:
    """(query, id, distance): of each of ``asked`` (query, vector, lists, s) the k nearest among the n nearest rows of its lists.

    A task has one slice s of the queries, and ``held`` (id, vector, list_id, s, ...) goes by it list by list and batch by batch; so it
    holds queries, their short lists and a batch, and a query's rows are never brought together elsewhere.
    ``compare(nearest, some, list_id, batch, x, ids)`` takes the place of distances for choosing the n."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = held.schema["id"].dataType, asked.schema["query"].dataType
    id_type = to_arrow_type(kind)

    def groups(tables: list[pa.RecordBatch]) -> list[tuple]:
        every = {c: pa.concat_arrays([t.column(c) for t in tables]) for c in ("query", "vector", "lists")}
        lists, vectors = every["lists"].to_pylist(), every["vector"]
        # those with the same lists side by side
        order = np.array(sorted(range(len(lists)), key=lists.__getitem__), np.int64)
        out = []
        for at in range(0, len(order), TOGETHER):
            own = order[at : at + TOGETHER]
            v = vectors.take(pa.array(own))
            places: dict[int, list[int]] = {}
            for j, i in enumerate(own):
                for one in lists[i]:
                    places.setdefault(one, []).append(j)
            out.append((every["query"].take(pa.array(own)), (ShortLists if compare else Nearest)(matrix(v, len(v[0])), n, metric), {one: np.array(j) for one, j in places.items()}))
        return out

    def run(batches):
        tables: list[pa.RecordBatch] = []
        ready: list[tuple] = []
        for b in batches:
            lists = b.column("list_id").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)] if len(lists) else []
            for a, z in zip(edges, edges[1:]):
                part, one = b.slice(a, z - a), int(lists[a])
                if one < 0:  # queries are first
                    tables.append(part)
                    continue
                ready = ready or (groups(tables) if tables else [])
                if not ready:
                    continue
                x, ids = matrix(part.column("vector"), ready[0][1].q.shape[1]), part.column("id").to_numpy(zero_copy_only=False)
                screen = None if compare else Screen(x, metric)
                for _, nearest, places in ready:
                    if one in places:
                        if compare:
                            compare(nearest, places[one], one, part, x, ids)
                        else:
                            nearest.rows(places[one], screen, ids)
        for names, nearest, _ in ready:
            query, ids, d = nearest.nearest(k)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query, pa.int64())), pa.array(ids.tolist(), id_type), pa.array(d, pa.float64())], ["query", "id", "distance"])

    extra = [c for c in held.columns if c not in ("id", "vector", "list_id", "s")]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    left = asked.select("s", F.lit(-1).alias("list_id"), "query", none(held, "id"), "vector", "lists", *[none(held, c) for c in extra])
    right = held.select("s", "list_id", none(asked, "query"), "id", "vector", none(asked, "lists"), *extra)
    both = left.unionByName(right).repartitionById(slices, F.col("s")).sortWithinPartitions("list_id")
    return both.mapInArrow(run, T.StructType().add("query", name).add("id", kind).add("distance", T.DoubleType()))


def knn_join(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", block_rows: int = 16_384) -> DataFrame:
    """:func:`knn` of a table ``queries`` (id, vector) against ``rows`` (id, vector), as a join.

    Queries are cut by hash into slices of about ``block_rows`` at most, of which a task has one; all rows go by each of them in
    batches. So the rows are sent once for each slice, a task's memory is bounded, and what leaves it is the result. All pairs
    have to meet, as it is exact."""
    check(metric in METRICS, "invalid_metric", metric)
    check(k >= 1, "invalid_limit")
    asked = queries.filter("vector is not null").select(F.col("id").alias("query"), "vector")
    held = rows.filter("vector is not null").select("id", "vector")
    n = asked.count()
    busy = 2 * queries.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-n // slice_rows(k, block_rows)), min(busy, -(-n // TOGETHER)))
    asked = asked.withColumn("lists", F.array(F.lit(0))).withColumn("s", F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int"))
    held = held.withColumn("list_id", F.lit(0)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return join_slices(asked, held, slices, k, k, metric)


# Scalar quantization


def float16(v: np.ndarray) -> np.ndarray:
    return v.astype(np.float16).astype(np.float32)


def calibrate(rows: DataFrame, vector_col: str = "vector") -> DataFrame:
    """(dim, low, high): least and greatest value of each dimension. A task sends one row of each, not its vectors' values."""

    def extremes(batches):
        low = high = None
        for b in batches:
            if len(b):
                x = matrix(b.column(0), len(b.column(0)[0]))
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64())) for v in (low, high)], ["low", "high"])

    each = rows.filter(F.col(vector_col).isNotNull()).select(vector_col).mapInArrow(extremes, "low array<double>, high array<double>")
    return each.select(F.posexplode(F.arrays_zip("low", "high")).alias("dim", "x")).groupBy("dim").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))


def encode_int8(v: Column, low: Sequence[float], high: Sequence[float]) -> Column:
    """Codes 0..255: (x - low) * 255 / range, rounded half to even and clamped; a flat dimension has scale 1."""
    scale = [(h - a) / 255 if h - a > 1e-7 else 1.0 for a, h in zip(low, high)]
    lows, scales = vector(low), vector(scale)
    return F.transform(F.zip_with(v, F.arrays_zip(lows.alias("a"), scales.alias("s")), lambda x, c: F.bround((x.cast("double") - c["a"]) / c["s"])), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("smallint"))


def decode_int8(codes: Column, low: Sequence[float], high: Sequence[float]) -> Column:
    scale = [(h - a) / 255 if h - a > 1e-7 else 1.0 for a, h in zip(low, high)]
    return F.zip_with(codes, F.arrays_zip(vector(low).alias("a"), vector(scale).alias("s")), lambda c, p: p["a"] + c.cast("double") * p["s"])


def encoded_bytes(n: Column, dimension: int, quantization: str) -> Column:
    return {"float32": n * 4 * dimension, "float16": n * 2 * dimension, "int8": n * dimension + 8 * dimension}[quantization]


def pool(tokens: Column, weights: Column | None = None) -> Column:
    """Mean of an array of vectors (weighted, if so), of unit length."""
    w = F.transform(tokens, lambda _: F.lit(1.0)) if weights is None else F.transform(weights, lambda x: x.cast("double"))
    pairs = F.arrays_zip(tokens.alias("t"), w.alias("w"))
    zero = F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0))
    total = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["t"], lambda a, b: a + b.cast("double") * p["w"]))
    return normalize(total)

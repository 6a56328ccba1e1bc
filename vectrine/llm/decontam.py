"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman over words.

One scan counts, for each run of N words of a benchmark item, the documents that have it. Of each BLOCK
runs in a row of an item, the rarest that the corpus has at all is a seed, so that common phrases never are where
there is another, and any 2 * BLOCK + N - 2 words copied in order hold a seed. A second scan finds the seeds, cuts out the
words around them and aligns those to the item: a word that matches scores 1, one
that differs or is missing or inserted costs 1. A document is contaminated if the best local score
reaches THRESHOLD of the item's length, but LEAST words at least, or ENOUGH words: an exact copy of a
quarter of an item, and most of those with three words in ten changed.

The benchmark is taken in slices of at most MOST_RUNS runs; a larger one takes two scans for each slice,
with the same result.

Defined cases: null ids or texts on either side match nothing; an item of fewer than LEAST words has to be copied whole,
and one of fewer than N words is a single run, so that a benchmark with an item of one common word taints every
document that has it (leave such items out of the benchmark); items without a word match nothing; repeated rows of a
document count for a run's frequency each, repeated rows of a document or item give one row; an empty table on either
side gives an empty result; ids are numbers or cast to them; other columns are ignored, and kept by :func:`decontaminate`;
texts are whole, and alignments bounded by cells, not by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.kernel import U64, Words, blocks, mix, text_array
from vectrine.llm.shared import keep_rows, materialise, own, prepare

N = 3
#: Runs in order of which one is a seed.
BLOCK = 3
#: A copy scores this share of its item, but LEAST words at least (or the whole item), or ENOUGH words however long the item.
THRESHOLD, LEAST, ENOUGH = 0.25, 9, 13
#: Runs of benchmark words that are sent to the workers at once, 40 bytes each.
MOST_RUNS = 2_000_000
#: Cells of the alignment that are held at once.
CELLS = 1 << 19
RESULT = "doc_id bigint, item_id bigint, score double, first_word int, last_word int"
_FILTER_BITS = 22


class Items:
    """Benchmark items of one slice: the distinct hashes of their runs, and each run's item and place."""

    def __init__(self, ids: list[int], texts: list[str], n: int) -> None:
        w = Words(pa.array(texts, pa.string()))
        self.ids, self.words, self.n = ids, [w.hash[a:b] for a, b in zip(w.first, w.first[1:])], n
        self.length = np.diff(w.first)
        runs = []
        for size in range(1, n + 1):  # a shorter item is one run, all of it
            gram, at = w.ngrams(size)
            item = np.searchsorted(w.first, at, "right") - 1
            ok = (self.length[item] >= n) if size == n else self.length[item] == size
            runs.append((gram[ok], item[ok], (at - w.first[item])[ok], np.full(int(ok.sum()), size)))
        gram, self.item, self.place, size = (np.concatenate(x) for x in zip(*runs))
        self.sizes = np.unique(size).tolist()
        self.gram, self.run = np.unique(gram, return_inverse=True)

    def seeds(self, docs: np.ndarray, block: int) -> "Seeds":
        """Of each ``block`` runs in order of an item the rarest that ``docs`` (by run) has at all; counts within a
        factor of eight are alike, so that the runs which edited copies lack aren't preferred, and go by hash."""
        n = docs[self.run]
        rank = np.floor(np.log2(np.maximum(n, 1)) / 3)
        order = np.lexsort((mix(self.gram)[self.run], rank, self.place // block, self.item))
        order = order[n[order] > 0]
        group = np.stack([self.item[order], self.place[order] // block])
        first = np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0))[: len(order)]
        return Seeds(self, order[first])


class Lookup:
    """Sorted hashes behind a filter of their low bits."""

    def __init__(self, gram: np.ndarray) -> None:
        self.gram = gram
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[gram & U64((1 << _FILTER_BITS) - 1)] = True

    def __call__(self, w: Words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the word where a run begins, the run's first place among the sorted) of each that is there."""
        out = []
        for size in sizes:
            gram, at = w.ngrams(size)
            some = np.flatnonzero(self.filter[gram & U64((1 << _FILTER_BITS) - 1)])
            at, lo = at[some], np.searchsorted(self.gram, gram[some])
            there = np.flatnonzero(self.gram[np.minimum(lo, len(self.gram) - 1)] == gram[some]) if len(self.gram) else []
            out.append((at[there], lo[there]))
        return tuple(np.concatenate(x) for x in zip(*out))


class Seeds(Lookup):
    """What the aligning scan is sent: the seeds' hashes with their item and place, and the items' words."""

    def __init__(self, items: Items, chosen: np.ndarray) -> None:
        order = chosen[np.argsort(items.gram[items.run[chosen]], kind="stable")]
        super().__init__(items.gram[items.run[order]])
        self.item, self.place = items.item[order], items.place[order]
        self.ids, self.words, self.length, self.sizes = items.ids, items.words, items.length, items.sizes

    def windows(self, w: Words):
        """(text, item, first word in the text, words) around each cluster of seeds."""
        at, lo = self(w, self.sizes)
        many = np.searchsorted(self.gram, self.gram[lo], "right") - lo
        run = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        text = np.searchsorted(w.first, at, "right") - 1
        item, begin = self.item[run], at - self.place[run]
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        new = np.ones(len(at), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > self.length[item[1:]])
        cuts = np.append(np.flatnonzero(new), len(at))
        for a, b in zip(cuts, cuts[1:]):
            t, i = int(text[a]), int(item[a])
            slack = int(self.length[i]) // 2
            lo, hi = max(int(begin[a]) - slack, w.first[t]), min(int(begin[b - 1]) + int(self.length[i]) + slack, w.first[t + 1])
            yield t, i, int(lo - w.first[t]), w.hash[lo:hi]


def needed(length: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Least score by item length."""
    return np.minimum(ENOUGH, np.maximum(threshold * length, np.minimum(length, LEAST)))


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Smith-Waterman of (document words, item words) pairs at once: (score, first, last document word)."""
    out = [(0, 0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]))
    at = 0
    while at < len(order):
        part = [order[at]]
        while at + len(part) < len(order) and (len(part) + 1) * len(pairs[order[at + len(part)]][0]) <= CELLS:
            part.append(order[at + len(part)])
        at += len(part)
        m, n = max(len(pairs[k][0]) for k in part), max(len(pairs[k][1]) for k in part)
        if not m or not n:
            continue
        doc, item = np.zeros((len(part), m), U64), np.zeros((len(part), n), U64)
        has_d, has_i = np.zeros((len(part), m), bool), np.zeros((len(part), n), bool)
        for r, k in enumerate(part):
            d, i = pairs[k]
            doc[r, : len(d)], has_d[r, : len(d)], item[r, : len(i)], has_i[r, : len(i)] = d, True, i, True
        # A cell is score * 2**32 + begin, so that the maximum carries where the alignment begins.
        # Column c stands between document words: c of them are behind it.
        unit = np.int64(1) << 32
        column = np.arange(m + 1, dtype=np.int64)
        cell = np.broadcast_to(column, (len(part), m + 1))
        best, where = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for j in range(n):
            step = np.where((doc == item[:, j : j + 1]) & has_d & has_i[:, j : j + 1], unit, -unit)
            now = cell - unit
            now[:, 1:] = np.maximum(now[:, 1:], cell[:, :-1] + step)
            now = np.where(now >= unit, now, column)
            now = np.maximum.accumulate(now + column * unit, axis=1) - column * unit
            cell = np.where(now >= unit, now, column)
            top = cell.argmax(axis=1)
            value = cell[np.arange(len(part)), top]
            better = value >> 32 > best >> 32
            best, where = np.where(better, value, best), np.where(better, top, where)
        for r, k in enumerate(part):
            out[k] = (int(best[r] >> 32), int(best[r] & 0xFFFFFFFF), int(where[r]) - 1)
    return out


def _slices(bench: DataFrame, n: int, most_runs: int):
    words = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")).cast("bigint")
    many = -(-int(bench.agg(F.sum(words)).first()[0] or 0) // most_runs)
    for k in range(many):
        rows = bench.filter(F.pmod(F.xxhash64("id"), F.lit(many)) == k).orderBy("id", "text").collect()
        yield Items([r.id for r in rows], [r.text for r in rows], n)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = N, most_runs: int = MOST_RUNS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """RESULT: each document and item whose best alignment scores what :func:`needed` says or more."""
    spark = prepare(docs.sparkSession)
    rows = own(docs, id=id_col, text=text_col).filter("id is not null and text is not null").select(F.col("id").cast("bigint"), "text")
    bench = own(benchmark, id=item_col, text=item_text_col).filter("id is not null and text is not null").select(F.col("id").cast("bigint"), "text").distinct()
    out = spark.createDataFrame([], RESULT)
    for items in _slices(bench, n, most_runs):
        if len(items.gram):
            out = out.union(aligned(rows, items.seeds(document_frequency(rows, items), BLOCK), threshold))
    best = F.max(F.struct("score", (-F.col("first_word")).alias("first"), "last_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.first")).alias("first_word"), "b.last_word")


def document_frequency(rows: DataFrame, items: Items) -> np.ndarray:
    """Of each run of ``items``: how many of the rows (id, text) have it. Counts are summed a batch at a time."""
    sizes, shared = items.sizes, rows.sparkSession.sparkContext.broadcast(Lookup(items.gram))

    def count(batches):
        for batch in batches:
            text, found = text_array(batch.column(0)), []
            for i, j in blocks(text):
                w = Words(text.slice(i, j - i))
                at, run = shared.value(w, sizes)
                doc = np.searchsorted(w.first, at, "right").astype(np.int64)
                found.append(np.unique(doc << 32 | run) & 0xFFFFFFFF)
            run, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(run.astype(np.int32)), pa.array(n.astype(np.int64))], ["run", "n"])

    got = rows.select("text").mapInArrow(count, "run int, n bigint").groupBy("run").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.gram), np.int64)
    out[got.column("run").to_numpy()] = got.column("n").to_numpy()
    return out


def aligned(rows: DataFrame, seeds: Seeds, threshold: float) -> DataFrame:
    """RESULT of every window around seeds that scores enough."""
    shared = rows.sparkSession.sparkContext.broadcast(seeds)

    def scan(batches):
        own_seeds = shared.value
        least = needed(own_seeds.length, threshold)
        for batch in batches:
            text = text_array(batch.column(1))
            for i, j in blocks(text):
                found = list(own_seeds.windows(Words(text.slice(i, j - i))))
                got = align([(f[3], own_seeds.words[f[1]]) for f in found])
                keep = [(f, g) for f, g in zip(found, got) if g[0] >= least[f[1]]]
                if keep:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i + f[0] for f, _ in keep])), pa.array([own_seeds.ids[f[1]] for f, _ in keep], pa.int64()), pa.array([g[0] / len(own_seeds.words[f[1]]) for f, g in keep]), pa.array([f[2] + g[1] for f, g in keep], pa.int32()), pa.array([f[2] + g[2] for f, g in keep], pa.int32())],
                        ["doc_id", "item_id", "score", "first_word", "last_word"],
                    )

    return rows.mapInArrow(scan, RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    gone = materialise(contaminated(docs, benchmark, threshold, id_col=id_col, text_col=text_col, **names).select("doc_id").distinct(), "contaminated")
    return keep_rows(docs, gone, id_col)

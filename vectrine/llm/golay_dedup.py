"""SimHash near-dedup by Golay-code fuzzy hashing.

1. Fingerprint: distinct words vote on 184 bits = 8 segments of 23 bits, held as four longs of
   two segments. Distinct pairs of neighbouring words vote on 64 bits more, for verification only:
   long texts of one language use the same words, but not in the same order.
2. Texts of one fingerprint collapse to the least id, which alone goes on.
3. Each segment is decoded to the Golay codeword indices within reach of its one-bit ball: one
   or six indices of 12 bits. Two segments that differ in at most 2 bits share one surely, with 3 or 4 bits in
   three cases of five. Candidates are the pairs that share an index in three segments at least (36 bits).
   Pigeonhole: with e errors over the 8 segments, at most floor(e / 3) have more than 2, so up to SURE = 17 errors
   three segments share surely; at the RADIUS of 32 they still do in 93 % of cases.
4. Of three segments two lie in one half (of four), so a fingerprint is sent once for each index of the first
   segment of a pair in a half (six segments, 32 rows), and the others are decoded where it arrives: the
   second segment makes buckets, and very large buckets are split by the third. Rows come sorted and are worked on
   a few first indices at a time; the rows of one are what a task holds, once. Of what these expand to it holds one second
   segment's (row, index) pairs by ranges of the index, in eight bytes each, and works on a bounded number of members and
   pairs at once.
   Indices are not even: votes of one language lean one way, so a crowded index may have a tenth of all texts.
5. Each bucket verifies its members by both full distances, that of word pairs first, which few pass. Small buckets go
   together, breadth first: members are compared only to those not yet reached, which finds the bucket's connected
   components exactly. Large ones go alone, all pairs a block at a time, or breadth first where many are near, so that
   n copies of one another cost n comparisons and n - 1 edges, not n ** 2.
6. Components of all edges are the groups; the least id of each stays.

Defined cases: rows with a null id, and texts without a letter or digit (null, empty), are never
duplicates; rows that repeat an id are one document to the search, all of whose texts' groups are one, and
:func:`deduplicate` keeps one of them (the least text, then the least row as JSON); ids are numbers or cast to them;
other columns are ignored by the search and kept by :func:`deduplicate`; an empty table gives an empty result;
texts are used whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm import golay
from vectrine.llm.components import components
from vectrine.llm.kernel import Grams, Words, blocks, simhash_bits, text_array
from vectrine.llm.shared import free_name, keep_rows, materialise, own, prepare

SALTS = (0x51ED270B, 0x2545F491, 0x68E31DA4)
SEGMENTS, SEGMENT_BITS = 8, 23
BITS = SEGMENTS * SEGMENT_BITS
#: First segments of the pairs within each half of four.
FIRST = (0, 1, 2, 4, 5, 6)
#: Differing bits up to which three segments share an index surely.
SURE = 17
#: Rows (all of one first index at least), members of buckets (all of one at least) and pairs that are worked on at once.
CHUNK, MEMBERS, PAIRS = 1 << 16, 1 << 17, 1 << 17
#: Pairs (row, index) of a second segment that are held at once, where no single index has more.
PACKED = 1 << 20
#: Members up to which buckets go together, and from which a bucket is split.
ALONE, LARGE = 128, 16384
#: Near members behind a member, on average, from which a bucket that goes alone is walked breadth first.
MANY = 16
#: Bits that near duplicates differ in at most, of the 184 of words and the 64 of word pairs.
RADIUS, ORDER_RADIUS = 32, 24
PARTS = ("f0", "f1", "f2", "f3", "f4")
FP = ", ".join(f"{p} bigint" for p in PARTS)


def golay_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, ..., f4) of every row that has an id and a word."""
    prepare(docs.sparkSession)
    place = np.left_shift(np.int64(1), np.arange(2 * SEGMENT_BITS, dtype=np.int64))

    def run(batches):
        for batch in batches:
            text = text_array(batch.column(1))
            for i, j in blocks(text):
                w = Words(text.slice(i, j - i))
                some = np.flatnonzero(np.diff(w.first))
                bits = simhash_bits(w, SALTS)[some, :BITS].reshape(len(some), 4, 2 * SEGMENT_BITS).astype(np.int64) @ place
                order = np.packbits(simhash_bits(Grams(w, 2), (0,)), axis=1, bitorder="little").view(np.int64)[some, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(some)), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)], pa.array(order)], ["doc_id", *PARTS])

    rows = own(docs, id=id_col, text=text_col).filter("id is not null and text is not null")
    return rows.select(F.col("id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, {FP}")


def _segment(f: np.ndarray, s: int) -> np.ndarray:
    return (f[:, s // 2] >> SEGMENT_BITS * (s % 2)) & (1 << SEGMENT_BITS) - 1


def _expand(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) for every index of each word."""
    k, n = golay.keys(words)
    one, six = np.flatnonzero(n == 1), np.flatnonzero(n == 6)
    return np.concatenate([one, np.repeat(six, 6)]), np.concatenate([k[one, 0], k[six].ravel()])


def half_keys(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first segment and its index) of every fingerprint; f has the four longs of segments in a row."""
    rows, keys = [], []
    for p, a in enumerate(FIRST):
        r, k = _expand(_segment(f, a))
        rows.append(r)
        keys.append(p << golay.K | k)
    return np.concatenate(rows), np.concatenate(keys)


def shared(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """In how many segments fingerprints (rows) share an index."""
    out = np.zeros(len(f), np.int64)
    for s in range(SEGMENTS):
        (a, n), (b, m) = golay.keys(_segment(f, s)), golay.keys(_segment(g, s))
        a, b = np.where(np.arange(6) < n[:, None], a, -1), np.where(np.arange(6) < m[:, None], b, -2)
        out += (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    return out


def close(f: np.ndarray, g: np.ndarray, radius: int, order_radius: int = ORDER_RADIUS) -> np.ndarray:
    """Whether fingerprints (rows of the four longs and, if so, that of word pairs) are candidates and near duplicates."""
    near, distance = within(f, g, radius, order_radius)
    unsure = np.flatnonzero(near & (distance > SURE))
    near[unsure] = shared(f[unsure], g[unsure]) >= 3
    return near


def within(f: np.ndarray, g: np.ndarray, radius: int, order_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether fingerprints are within both radii, their distance)."""
    bits = np.bitwise_count((f ^ g).view(np.uint64))  # of signed numbers it counts the absolute value
    distance = bits[:, 0].astype(np.int32)
    for k in range(1, 4):
        distance += bits[:, k]
    near = distance <= radius
    for k in range(4, bits.shape[1]):
        near &= bits[:, k] <= order_radius
    return near, distance


def near_pairs(f: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int, order_radius: int) -> np.ndarray:
    """Which of the pairs of rows are near, a bounded number of them at a time."""
    return np.concatenate([np.zeros(0, bool), *[close(f[i[k : k + PAIRS]], f[j[k : k + PAIRS]], radius, order_radius) for k in range(0, len(i), PAIRS)]])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


class Buckets:
    """Near pairs within buckets of rows of ``f``. Pairs are first held to the last long alone, which few pass."""

    def __init__(self, f: np.ndarray, radius: int, order_radius: int) -> None:
        self.f, self.radius, self.order_radius = f, radius, order_radius
        self.last, self.most = np.ascontiguousarray(f[:, -1]), order_radius if f.shape[1] > 4 else radius

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return near_pairs(self.f, i, j, self.radius, self.order_radius)

    def verified(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are near, each once, of pairs that may recur."""
        pair = np.unique(np.minimum(i, j) << 32 | np.maximum(i, j))
        i, j = pair >> 32, pair & 0xFFFFFFFF
        ok = self.near(i, j)
        return i[ok], j[ok]

    def together(self, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that connect what is connected within each of many small buckets row[at:at + size].

        All buckets go round at once. In each round a bucket's next member that is reached but not yet
        expanded, or else its next unreached one, is compared to its unreached members.
        """
        found = []
        # queue[at:at + size]: members; the first `head` are expanded, up to `tail` reached, the rest not.
        queue, last = row.copy(), self.last[row]
        head, tail = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
        while len(at):
            rest = size - tail
            n = int(rest.sum())
            bucket = np.repeat(np.arange(len(at)), rest)
            slot = np.repeat(at + tail - np.cumsum(rest) + rest, rest) + np.arange(n)
            hit = np.flatnonzero(_bits(last[at + head][bucket] ^ last[slot]) <= self.most)
            pivot, member = queue[at + head][bucket[hit]], queue[slot[hit]]
            ok = self.near(pivot, member)
            hit = hit[ok]
            found.append((pivot[ok], member[ok]))
            if len(hit):  # the near members move to the front of the unreached
                near, touched = np.zeros(n, bool), np.zeros(len(at), bool)
                near[hit], touched[bucket[hit]] = True, True
                some = np.flatnonzero(touched[bucket])
                slot, move = slot[some], np.lexsort((~near[some], bucket[some]))
                queue[slot], last[slot] = queue[slot[move]], last[slot[move]]
                tail = tail + np.bincount(bucket[hit], minlength=len(at))
            head = head + 1
            tail = np.maximum(tail, head + 1)  # nothing reached is left: the next unreached one starts anew
            live = tail < size
            at, size, head, tail = at[live], size[live], head[live], tail[live]
        return found

    def _block(self, last: np.ndarray, a: int, b: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (of a:b, of c: and behind the first) that pass by the last long."""
        hit = np.flatnonzero(_bits(last[a:b, None] ^ last[None, c:]) <= self.most)
        p, q = np.divmod(hit, len(last) - c)
        p, q = p + a, q + c
        behind = q > p
        return p[behind], q[behind]

    def alone(self, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for one large bucket, whose members are compared to all behind them a block at a time; where
        many are near, breadth first, so that n copies of one another cost n comparisons. Pairs are within the radii,
        and near where what they connect rests on them: :meth:`verified` tells."""
        row, last, found, i, n, wide = row.copy(), self.last[row], [], 0, len(row), 8
        while i < n - 1:
            j = i + max(1, min(wide, n - i, PAIRS // (n - i)))
            p, q = self._block(last, i, j, i + 1)
            ok = within(self.f[row[p]], self.f[row[q]], self.radius, self.order_radius)[0]
            if np.count_nonzero(ok) <= MANY * (j - i):
                found.append((row[p[ok]], row[q[ok]]))
                i, wide = j, min(64, 2 * wide)
                continue
            head, tail, wide = i, i + 1, 8
            while head < tail < n:  # expanded up to head, reached up to tail
                j = head + max(1, min(64, tail - head, PAIRS // (n - tail)))
                p, q = self._block(last, head, j, tail)
                ok = self.near(row[p], row[q])
                q, first = np.unique(q[ok], return_index=True)
                found.append((row[p[ok][first]], row[q]))
                if len(q):
                    far = np.ones(n - tail, bool)
                    far[q - tail] = False
                    order = np.append(q, tail + np.flatnonzero(far))
                    row[tail:], last[tail:] = row[order], last[order]
                head, tail = j, tail + len(q)
            i = tail
        return found

    def edges(self, packed: np.ndarray, split: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows, from sorted ``packed``: bucket << 32 | row. About MEMBERS are worked on at once.

        Buckets of more than LARGE members are left to ``split``, if any: it gets (bucket number, row) and gives packed rows anew.
        """
        i = 0
        while i < len(packed):
            j = len(packed)
            if i + MEMBERS < j:
                key = packed[i + MEMBERS] >> 32
                j = int(np.searchsorted(packed, key << 32))
                if j <= i:
                    j = int(np.searchsorted(packed, key + 1 << 32))
            key, row = packed[i:j] >> 32, packed[i:j] & 0xFFFFFFFF
            i = j
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(at, len(key)))
            large = size > LARGE if split else np.zeros(len(at), bool)
            small = ~large & (size > 1) & (size <= ALONE)
            if small.any():
                yield from self.together(row, at[small], size[small])
            loose, n = [], 0
            for x, m in zip(at[~large & (size > ALONE)], size[~large & (size > ALONE)]):
                for pair in self.alone(row[x : x + m]):
                    loose.append(pair)
                    n += len(pair[0])
                if n > MEMBERS:
                    yield self.verified(*map(np.concatenate, zip(*loose)))
                    loose, n = [], 0
            if loose:
                yield self.verified(*map(np.concatenate, zip(*loose)))
            if large.any():
                some = np.repeat(large, size)
                for again in split(np.repeat(np.arange(len(at)), size)[some], row[some]):
                    yield from self.edges(again)


def _pack(number: np.ndarray, row: np.ndarray, f: np.ndarray, s: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """(number, codeword index) << 32 | row for every index of each row's segment ``s``, sorted; of ``parts`` ranges of indices, one."""
    out = [np.zeros(0, np.int64)]
    for i in range(0, len(row), CHUNK):
        here = row[i : i + CHUNK]
        r, k = _expand(_segment(f[here], s))
        if parts > 1:
            some = np.flatnonzero(k * parts >> golay.K == part)
            r, k = r[some], k[some]
        out.append((number[i : i + CHUNK][r] << golay.K | k) << 32 | here[r])
    packed = np.concatenate(out)
    packed.sort()
    return packed


def _distinct_edges(pairs: Iterator[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> np.ndarray:
    """Distinct (lesser id, greater id) of pairs of rows, folded as they come."""
    known = np.unique(ids)
    number = np.searchsorted(known, ids)
    done, held, n = np.zeros(0, np.int64), [], 0
    for i, j in pairs:
        u, v = number[i], number[j]
        some = u != v
        held.append(np.minimum(u, v)[some] << 32 | np.maximum(u, v)[some])
        n += len(i) + 100
        if n > max(MEMBERS, len(done)):
            done, held, n = np.unique(np.concatenate([done, *held])), [], 0
    done = np.unique(np.concatenate([done, *held]))
    return np.stack([known[done >> 32], known[done & 0xFFFFFFFF]], axis=1)


def bucket_edges(key: np.ndarray, ids: np.ndarray, f: np.ndarray, radius: int, order_radius: int = ORDER_RADIUS) -> np.ndarray:
    """Edges (u, v) that connect what is connected within each bucket by near duplicates."""
    packed = np.unique(key, return_inverse=True)[1] << 32 | np.arange(len(key))
    packed.sort()
    return _distinct_edges(Buckets(f, radius, order_radius).edges(packed), ids)


def group_edges(half: np.ndarray, ids: np.ndarray, f: np.ndarray, radius: int = RADIUS, order_radius: int = ORDER_RADIUS) -> np.ndarray:
    """Edges (u, v) within the buckets of whole half keys."""
    buckets = Buckets(f, radius, order_radius)
    number, first = np.searchsorted(np.unique(half), half), np.array(FIRST, np.int8)[half >> golay.K]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in range(1, SEGMENTS):
            here = np.flatnonzero((first // 4 == b // 4) & (first < b))

            def third(bucket: np.ndarray, row: np.ndarray) -> Iterator[np.ndarray]:
                # Three segments of one half are left to the first two of them.
                for c in (c for c in range(SEGMENTS) if c // 4 != b // 4 or c > b):  # noqa: B023
                    yield _pack(bucket, row, f, c)

            parts = -(-6 * len(here) // PACKED)
            for part in range(parts):
                yield from buckets.edges(_pack(number[here], here, f, b, part, parts), third)

    return _distinct_edges(pairs(), ids)


def joined(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Columns of the pieces, which are taken out of ``held`` so that no column is there twice for long."""
    columns = [list(x) for x in zip(*held)]
    held.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def candidate_edges(one: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) edges between ``one`` (id, f0, ..., f4), rows of distinct fingerprints."""

    def keyed(batches):
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                f = np.stack([part.column(1 + k).to_numpy() for k in range(len(PARTS))], axis=1)
                rows, keys = half_keys(f)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[part.column(c).take(take) for c in range(1 + len(PARTS))]], ["half", "id", *PARTS])

    def edges(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = group_edges(*parts, radius)
        for i in range(0, len(e), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[i : i + CHUNK, k])) for k in (0, 1)], ["u", "v"])

    def verified(batches):
        held, n, enough = [], 0, CHUNK
        for b in batches:
            half, ids, *f = (c.to_numpy() for c in b.columns)
            held.append((half.copy(), ids.copy(), np.stack(f, axis=1)))  # else the whole batch stays as well
            n += len(b)
            if n >= enough:  # all but the last half key are whole
                whole = joined(held)
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                held = [tuple(x[cut:].copy() for x in whole)] if cut else [tuple(whole)]
                n -= cut
                enough = max(CHUNK, 2 * n)
                if cut:
                    yield from edges([x[:cut] for x in whole])
                del whole
        if n:
            yield from edges(joined(held))

    rows = one.mapInArrow(keyed, f"half bigint, id bigint, {FP}").repartition("half").sortWithinPartitions("half")
    return rows.mapInArrow(verified, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id): every document that goes, with the one of its group that stays."""
    fps = materialise(golay_fingerprints(docs, id_col, text_col), "golay")
    one = materialise(fps.groupBy(*PARTS).agg(F.min("doc_id").alias("id")).select("id", *PARTS), "golay-one")
    # Copies of a text are a star around the least of them, which alone is searched for.
    stands = materialise(fps.join(one, list(PARTS)).select("doc_id", F.col("id").alias("stand")), "golay-stands")
    several = stands.groupBy("doc_id").agg(F.min("stand").alias("u"), F.max("stand").alias("w")).filter("u != w").select("doc_id", "u")
    edges = candidate_edges(one, radius).union(stands.join(several, "doc_id").select("u", F.col("stand").alias("v")))
    found = stands.join(components(edges), F.col("stand") == F.col("node"), "left").select("doc_id", F.coalesce("root", "stand").alias("keep_id"))
    return found.filter("doc_id != keep_id").distinct()


def deduplicate(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group; of rows that repeat an id one stays."""
    gone = materialise(near_duplicates(docs, radius, id_col, text_col), "golay-gone")
    key = free_name(docs, "__twice")
    twice = materialise(docs.select(F.col(f"`{id_col}`").alias(key)).filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key), "golay-twice")
    kept = keep_rows(docs, gone.select("doc_id"), id_col)
    if twice.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = kept.join(twice, kept[f"`{id_col}`"] == twice[key], "left_semi")
    first = again.groupBy(F.col(f"`{id_col}`").alias(key)).agg(F.min_by(row, F.struct(F.col(f"`{text_col}`").alias("text"), F.to_json(row).alias("row"))).alias("row"))
    return keep_rows(kept, twice, id_col).unionByName(first.select("row.*"))

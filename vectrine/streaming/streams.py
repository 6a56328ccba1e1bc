"""Streams: the change log, ordered replication, admission by token buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vectrine.operators.collection import Collection
from vectrine.schema import check


def upsert_stream(changes: DataFrame, collection: Collection, checkpoint: str, trigger: dict | None = None, atomic: bool = False) -> StreamingQuery:
    """Fold every micro-batch of (seq, kind, id, text, vector, metadata) into a collection.

    A batch that runs again after a failure finds its number in the manifest's folder and is skipped."""

    def apply(batch: DataFrame, number: int) -> None:
        done = f"{collection.folder}/stream/{number:012d}"
        if batch.isEmpty() or collection.store.exists(done):
            return
        collection.mutate(batch, atomic, None)
        collection.store.put_if_absent(done, b"1")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


GEO_STATE = "next bigint, receipts array<string>"
GEO_OUT = "origin_id string, sequence bigint, event_id string, outcome string"
RECEIPTS = 10_000


def geo_step(origin: str, events: list[tuple[int, str, str]], state: tuple[int, list[str]], most: int = RECEIPTS) -> tuple[list[tuple], tuple[int, list[str]]]:
    """Outcomes of one origin's events (sequence, event_id, content hash) and the state after them.

    Only the next sequence is applied; a known event again is a duplicate; another event or content
    under a used number, or a gap, is a divergence and changes nothing. Receipts are capped."""
    next_, receipts = state
    known = {int(r.split("|", 1)[0]): r for r in receipts}
    out = []
    for seq, event, digest in events:
        receipt = f"{seq}|{event}|{digest}"
        if seq == next_:
            known[seq] = receipt
            next_ += 1
            outcome = "applied"
        else:
            outcome = "duplicate" if known.get(seq) == receipt else "divergence"
        out.append((origin, seq, event, outcome))
    return out, (next_, [known[s] for s in sorted(known)[-most:]])


def geo_inbox(events: DataFrame, most: int = RECEIPTS) -> DataFrame:
    """Outcome of each event of a stream (origin_id, sequence, event_id, content_hash, arrival), exactly once and in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        held = (state.get[0], list(state.get[1])) if state.exists else (1, [])
        out, held = geo_step(key[0], list(zip(pdf.sequence, pdf.event_id, pdf.content_hash)), held, most)
        state.update(held)
        yield pd.DataFrame(out, columns=["origin_id", "sequence", "event_id", "outcome"])

    return events.groupBy("origin_id").applyInPandasWithState(run, GEO_OUT, GEO_STATE, "append", GroupStateTimeout.NoTimeout)


class TokenBucket:
    """Tokens that refill at a rate up to a burst."""

    def __init__(self, rate: float, burst: float, now: float, tokens: float | None = None) -> None:
        self.rate, self.burst, self.at, self.tokens = rate, burst, now, burst if tokens is None else tokens

    def refill(self, now: float, ratio: float = 1.0) -> None:
        self.tokens = min(self.burst, self.tokens + max(0.0, now - self.at) * self.rate * ratio)
        self.at = max(self.at, now)

    def retry_after(self, cost: float, now: float, ratio: float = 1.0) -> float:
        self.refill(now, ratio)
        return 0.0 if self.tokens >= cost else (cost - self.tokens) / max(1e-300, self.rate * ratio)

    def take(self, cost: float) -> None:
        self.tokens = max(0.0, self.tokens - cost)


def admit(requests: DataFrame, rate: float, burst: float, cost: float = 1.0) -> DataFrame:
    """(client, request, accepted) of requests (client, request, at in seconds) by a bucket a client, in order of time.
    Rows are sorted and streamed, so that a client with very many requests is never held as a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, bucket = None, None
        for pdf in batches:
            out = []
            for c, at in zip(pdf["client"].tolist(), pdf["at"].tolist()):
                if bucket is None or c != client:
                    client, bucket = c, TokenBucket(rate, burst, at)
                out.append(not bucket.retry_after(cost, at))
                if out[-1]:
                    bucket.take(cost)
            yield pd.DataFrame({"client": pdf["client"], "request": pdf["request"], "accepted": out})

    kinds = [f"{c} {requests.schema[c].dataType.simpleString()}" for c in ("client", "request")]
    return requests.select("client", "request", "at").repartition("client").sortWithinPartitions("client", "at", "request").mapInPandas(run, ", ".join([*kinds, "accepted boolean"]))


def sign(events: DataFrame, key: str, *columns: str) -> DataFrame:
    """``events`` with ``signature``: HMAC-SHA-256 of the columns, each behind its length, by built-in functions only."""
    raw = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    pad = lambda b: F.lit(bytes(x ^ b for x in raw.ljust(64, b"\0")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0001"))
    message = F.encode(F.concat(*[F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)) for c in columns]), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    return events.withColumn("signature", F.sha2(F.concat(pad(0x5C), inner), 256))


SIGNED = ("origin_id", "sequence", "event_id", "content_hash")


def geo_outbox(collection: Collection, key: str, after: int = 0) -> DataFrame:
    """Signed events (origin_id, sequence, event_id, content_hash, op, id, text, vector, metadata, version) of the segments
    since the snapshot, numbered without gaps from ``after`` + 1; a segment's rows are numbered by id."""
    m, out = collection.manifest(), None
    first = after
    for s in m["segments"]:
        rows = collection._read([s])
        number = F.row_number().over(Window.partitionBy("seq").orderBy("id")) + F.lit(first)
        digest = F.sha2(F.to_json(F.struct("op", "id", "text", "vector", "version", F.array_sort(F.map_entries("metadata")).alias("metadata"))), 256)
        one = rows.select(F.lit(collection.definition.id).alias("origin_id"), number.cast("bigint").alias("sequence"), F.concat_ws(":", "seq", "id").alias("event_id"), digest.alias("content_hash"), "op", "id", "text", "vector", "metadata", "version")
        out, first = one if out is None else out.unionByName(one), first + s["rows"]
    check(out is not None, "nothing_to_send", collection.definition.name)
    return sign(out, key, *SIGNED)


def verified(events: DataFrame, key: str) -> DataFrame:
    """Events whose signature is of the key and of their content."""
    return sign(events.withColumnRenamed("signature", "__given"), key, *SIGNED).filter("signature = __given").drop("__given")


def request_cost(body_bytes: int) -> float:
    return 1 + body_bytes / 65_536


class AdaptiveRate:
    """Share of the contractual rate: down at once with pressure, up again over a recovery window."""

    def __init__(self, floor: float = 0.1, recovery: float = 30.0) -> None:
        self.floor, self.recovery, self.ratio, self.at = floor, recovery, 1.0, None

    def update(self, pressure: float, now: float) -> float:
        target = min(1.0, max(self.floor, 1 - pressure))
        elapsed = 0.0 if self.at is None else now - self.at
        self.at = now
        self.ratio = target if target < self.ratio else self.ratio + (target - self.ratio) * min(1.0, max(0.0, elapsed / self.recovery))
        return self.ratio


class Admission:
    """Contractual buckets by client, collection and kind of operation, and a global one of which reads and
    writes each have a reserve. A request is taken from all of its buckets or from none."""

    def __init__(self, rates: dict[str, tuple[float, float]], now: float = 0.0, read_reserve: float = 0.2, write_reserve: float = 0.1) -> None:
        check({"global", "client", "collection", "read", "write", "admin"} <= set(rates), "invalid_rates")
        self.rates, self.named = rates, {}
        part = lambda share: TokenBucket(rates["global"][0] * share, rates["global"][1] * share, now)
        self.shared, self.reserve = part(1 - read_reserve - write_reserve), {"read": part(read_reserve), "write": part(write_reserve)}
        self.operation = {k: TokenBucket(*rates[k], now) for k in ("read", "write", "admin")}

    def acquire(self, client: str, operation: str, cost: float, now: float, collection: str | None = None) -> tuple[bool, str | None, float]:
        """(accepted, scope that rejects, seconds to wait)."""
        check(cost > 0 and bool(client.strip()), "invalid_request")
        named = lambda scope, name: self.named.setdefault((scope, name), TokenBucket(*self.rates[scope], now))
        buckets = [("client", named("client", client))] + ([("collection", named("collection", collection))] if collection else []) + [(operation, self.operation[operation])]
        scope, wait = None, 0.0
        if operation != "admin":
            reserve = self.reserve[operation]
            self.shared.refill(now)
            reserve.refill(now)
            if self.shared.tokens + reserve.tokens < cost:
                scope, wait = "global", (cost - self.shared.tokens - reserve.tokens) / max(1e-300, self.shared.rate + reserve.rate)
        for name, b in buckets:
            if (w := b.retry_after(cost, now)) > wait:
                scope, wait = name, w
        if scope:
            return False, scope, wait
        for _, b in buckets:
            b.take(cost)
        if operation != "admin":
            own = min(cost, self.shared.tokens)
            self.shared.take(own)
            self.reserve[operation].take(cost - own)
        return True, None, 0.0


def admit_stream(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(client, request, accepted, retry_after) of a stream (client, request, at seconds, cost), a bucket a client."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["at", "request"], kind="stable")
        tokens, at = state.get if state.exists else (burst, float(pdf["at"].iloc[0]))
        b, out = TokenBucket(rate, burst, at, tokens), []
        for r in pdf.itertuples():
            wait = b.retry_after(r.cost, r.at)
            if not wait:
                b.take(r.cost)
            out.append((key[0], r.request, wait == 0, wait))
        state.update((b.tokens, b.at))
        yield pd.DataFrame(out, columns=["client", "request", "accepted", "retry_after"])

    return requests.groupBy("client").applyInPandasWithState(run, "client string, request bigint, accepted boolean, retry_after double", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)

"""Collections on disk: a catalog, a change log of Parquet segments, snapshots, paging and backups.

A collection is a folder: ``log/`` has a Parquet folder a segment; numbered manifests name the
segments that count, with their rows and digests, and the snapshot they are folded into. A commit writes its
data first and makes the next manifest last, so readers see all of it or nothing, and of two writers one fails.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.functions.distance import knn
from vectrine.operators import bm25, mutations
from vectrine.operators.chunking import ChunkOptions
from vectrine.operators.embedding import DIMENSION, embed, embed_text
from vectrine.operators.indexes import build_index, open_index
from vectrine.operators.search import SearchRequest, search
from vectrine.operators.store import Store
from vectrine.plans.lifecycle import Generations
from vectrine.schema import DOCUMENT, check, check_collection_name, invalid_rows, metadata
from vectrine.session import scratch_dir
from vectrine.sources.files import ingest

COMPACT_AT = 64
MAXIMUM_OFFSET = 10_000
LOG = T.StructType(list(DOCUMENT.fields)).add("op", T.StringType()).add("seq", T.LongType())


@dataclass
class Definition:
    name: str
    dimension: int
    metric: str = "cosine"
    index: str = "flat"
    id: str = ""
    created_at: str = ""


EMPTY = {"epoch": 0, "snapshot": None, "segments": [], "sequence": 0, "count": 0}


class Collection:
    def __init__(self, store: Store, definition: Definition) -> None:
        self.store, self.spark, self.definition = store, store.spark, definition
        self._number, self._seen = 0, None

    @property
    def folder(self) -> str:
        return f"collections/{self.definition.name}"

    # the log

    def manifest(self, stale: bool = False) -> dict:
        """The last one. A collection without any is damaged, not empty. A stale read may use the one that this object
        last saw, and lists no folder."""
        if stale and self._seen is not None:
            return self._seen
        found = self.store.latest(f"{self.folder}/manifests")
        check(found is not None, "manifest_missing", self.definition.name)
        self._number, self._seen = found
        return self._seen

    def _commit(self, manifest: dict) -> None:
        """Fails if another writer has committed since the manifest was read."""
        self.store.commit(f"{self.folder}/manifests", self._number, manifest)
        self._number, self._seen = self._number + 1, manifest
        self.store.prune(f"{self.folder}/manifests")

    def _write(self, rows: DataFrame, name: str) -> dict:
        """A segment's entry for the manifest: its name, rows and digest."""
        path = self.store.at(f"{self.folder}/log/{name}")
        rows.select(*[F.col(f.name).cast(f.dataType) for f in LOG.fields]).write.parquet(path)
        return {"name": name, **digest(self.spark.read.schema(LOG).parquet(path))}

    def _read(self, segments: list[dict]) -> DataFrame:
        paths = [self.store.at(f"{self.folder}/log/{s['name']}") for s in segments if s]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def verify(self) -> bool:
        """Whether every segment has the rows that were written."""
        m = self.manifest()
        return all(s == {"name": s["name"], **digest(self._read([s]))} for s in [m["snapshot"], *m["segments"]] if s)

    def log(self) -> DataFrame:
        m = self.manifest()
        return self._read([m["snapshot"], *m["segments"]])

    def documents(self, stale: bool = False) -> DataFrame:
        """Live rows: the snapshot's without the ids of the segments since, and those folded. The snapshot is neither
        sorted nor shuffled while the segments' ids are few enough for the planner to broadcast."""
        m = self.manifest(stale)
        snapshot = self._read([m["snapshot"]] if m["snapshot"] else []).select(*DOCUMENT.fieldNames())
        if not m["segments"]:
            return snapshot
        since = self._read(m["segments"])
        return snapshot.join(since.select("id").distinct(), "id", "left_anti").unionByName(mutations.latest(since).select(*DOCUMENT.fieldNames()))

    def append(self, changes: DataFrame, compact_at: int = COMPACT_AT) -> None:
        """Write one segment of (op, id, text, vector, metadata, version) and name it in the manifest."""
        m = self.manifest()
        seq = m["sequence"] + 1
        rows = changes.withColumn("seq", F.lit(seq).cast("bigint")).withColumn("updated_at", F.current_timestamp())
        segment = self._write(rows, f"segment-{seq:012d}-{uuid.uuid4().hex[:8]}")
        m = m | {"sequence": seq, "segments": [*m["segments"], segment], "epoch": m["epoch"] + 1, "count": None}
        self._commit(m)
        if len(m["segments"]) >= compact_at:
            self.compact()

    def compact(self) -> None:
        """Fold the log into one snapshot. What the snapshot before that replaced is deleted; what this one replaces
        stays where readers that have begun look for it, until the next time."""
        m = self.manifest()
        live = self.documents().withColumns({"op": F.lit("upsert"), "seq": F.lit(m["sequence"]).cast("bigint")})
        snapshot = self._write(live, f"snapshot-{m['sequence']:012d}-{uuid.uuid4().hex[:8]}")
        old = [s["name"] for s in [m["snapshot"], *m["segments"]] if s]
        self._commit(m | {"snapshot": snapshot, "segments": [], "count": snapshot["rows"], "epoch": m["epoch"] + 1, "replaced": old})
        for name in m.get("replaced", []):
            self.store.delete(f"{self.folder}/log/{name}")

    def mutate(self, batch: DataFrame, atomic: bool = True, maximum: int | None = mutations.MAXIMUM_BATCH) -> DataFrame:
        """Results (seq, id, succeeded, error_code, version) of a batch (seq, kind, id, text, vector, metadata)."""
        if maximum is not None:
            mutations.check_size(batch, maximum)
        kept = batch.filter("kind != 'delete'")
        needs = kept.withColumn("vector", F.when((F.col("kind") == "update") & F.col("vector").isNull(), F.array_repeat(F.lit(0.0).cast("float"), self.definition.dimension)).otherwise(F.col("vector")))
        large = bm25.too_long(kept.select("seq", "text")).select("seq", F.lit("text_too_large").alias("error_code"))
        bad = invalid_rows(needs, self.definition.dimension).select("seq", "error_code").unionByName(large).groupBy("seq").agg(F.min("error_code").alias("error_code"))
        results, rows = mutations.fold(self.documents(), batch, atomic, None, bad)
        results = self._stored(results)
        rows = rows.filter("op is not null")
        if not rows.isEmpty():
            self.append(rows)
        return results

    def _stored(self, results: DataFrame) -> DataFrame:
        """A batch's results, one row a mutation: kept apart from the log that they would otherwise re-read."""
        path = self.store.at(f"{self.folder}/results/{uuid.uuid4().hex}")
        results.write.parquet(path)
        return self.spark.read.schema(mutations.RESULT).parquet(path)

    # reads

    def count(self) -> int:
        """From the manifest where it is known, else from the log."""
        known = self.manifest()["count"]
        return known if known is not None else self.documents().count()

    def get(self, ids: list[str]) -> DataFrame:
        return by_ids(self.documents(), ids)

    def page(self, limit: int, offset: int = 0, token: str | None = None) -> tuple[DataFrame, str | None]:
        return page(self.documents(), self.definition.name, self.manifest()["epoch"], limit, offset, token)

    def search(self, request: SearchRequest) -> DataFrame:
        """Of the last commit; a stale read of what this object last saw. A request that needs a vector and has a text only
        gets the text's. Vectors are searched through the collection's index, where one has
        been built and isn't older than the snapshot; rows that changed since are taken from the log."""
        stale, d = request.consistency == "stale", self.definition
        if request.vector is None and request.mode in ("vector", "hybrid") and request.text:
            request = replace(request, vector=self.embedded(request.text))
        m = self.manifest(stale)
        return search(self.documents(stale), request, d.metric, dimension=d.dimension, nearest=self._nearest(m))

    def embedded(self, text: str) -> list[float]:
        check(self.definition.dimension == DIMENSION, "dimension_mismatch", f"texts are embedded in {DIMENSION} dimensions")
        return embed_text(text).tolist()

    def vectorised(self, batch: DataFrame) -> DataFrame:
        """``batch`` with the vectors of texts that come without one."""
        check(self.definition.dimension == DIMENSION, "dimension_mismatch", f"texts are embedded in {DIMENSION} dimensions")
        bare = F.col("vector").isNull() & F.col("text").isNotNull() & (F.col("kind") != "delete")
        return batch.withColumn("vector", F.when(bare, embed(F.when(bare, F.col("text")))).otherwise(F.col("vector")))

    def ingest(self, path: str, options: ChunkOptions = ChunkOptions(), batch: int = 500) -> int:
        """Chunks of a file, folder or glob as documents with the fields of the chunk as metadata, in batches; chunks that
        a document no longer has are deleted. Gives the number of chunks."""
        rows = ingest(self.spark, path, self.definition.dimension, options).withColumn("ingested_at", F.current_timestamp())
        scratch = f"{scratch_dir(self.spark)}/ingest-{uuid.uuid4().hex}"
        fields = {
            "source_file": ("text", "path"), "content_sha256": ("text", "content_sha256"), "document_id": ("text", "document_id"), "document_format": ("text", "format"), "chunk_sequence": ("integral", "sequence"),
            "chunk_tokens": ("integral", "estimated_tokens"), "locations": ("text_array", "locations"), "heading": ("text", "heading"), "ingested_at": ("datetime", "ingested_at"),
        }
        rows.select("id", "text", "vector", metadata(**fields).alias("metadata"), F.element_at(F.split("path", "/"), -1).alias("file")).write.parquet(scratch)
        rows = self.spark.read.parquet(scratch)
        held = lambda df: df.select("id", F.col("metadata")["source_file"]["keys"][0].alias("file"))
        stale = held(self.documents()).join(held(rows).select("file").distinct(), "file", "left_semi").join(rows.select("id"), "id", "left_anti")
        n, parts = rows.count(), max(1, -(-rows.count() // batch))
        # a batch is a segment: few large ones where there is much to add
        parts = min(parts, COMPACT_AT - 1)
        gone = stale.select(F.lit("delete").alias("kind"), "id", *[F.lit(None).cast(DOCUMENT[c].dataType).alias(c) for c in ("text", "vector", "metadata")])
        for p in range(parts):
            part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).select(F.lit("upsert").alias("kind"), "id", "text", "vector", "metadata")
            part = part.unionByName(gone) if p == 0 else part
            results = self.mutate(part.withColumn("seq", F.monotonically_increasing_id()), atomic=False, maximum=None)
            wrong = results.filter("not succeeded and error_code != 'document_not_found'").first()
            check(wrong is None, wrong.error_code if wrong else "", "ingest")
        return n

    # the index

    def migrate(self, kind: str, **options) -> float | None:
        """Take another kind of index while the old one serves and writes go on: it is built of the last commit, and what is
        written meanwhile comes from the log. The definition changes only once the new one has been accepted."""
        recall = self.build_index(kind=kind, **options)
        self._use(kind)
        return recall

    def rollback_index(self) -> None:
        """Back to the generation before, and to its kind."""
        generations = Generations(self.store, self.definition.name).load()
        generations.rollback()
        self._use(generations.active["kind"])

    def _use(self, kind: str) -> None:
        self.definition.index = kind
        self.store.put(f"{self.folder}/definition.json", json.dumps(self.definition.__dict__).encode())

    def build_index(self, minimum_recall: float = 0.9, k: int = 10, asked: int = 64, kind: str | None = None, **options) -> float | None:
        """A new generation of the index that the definition names, of the last commit; it takes over if its recall, of
        the first ids against the exact search, is enough. Gives the recall; a flat collection has no index."""
        kind, m = kind or self.definition.index, self.manifest()
        generations = Generations(self.store, self.definition.name).load()
        if kind == "flat":
            return None
        folder = f"{self.folder}/indexes/{uuid.uuid4().hex}"
        rows = self.documents().filter("vector is not null").select("id", "vector")
        index = build_index(kind, rows, self.store.at(folder), self.definition.metric, **options)
        queries = [(r.id, r.vector) for r in rows.orderBy("id").limit(asked).collect()]
        if queries:
            truth = {(r.query, r.id) for r in knn(rows, queries, k, self.definition.metric).collect()}
            found = {(i, r.id) for i, v in queries for r in index.nearest(v, k).collect()}
            recall = len(truth & found) / len(truth)
            check(recall >= minimum_recall, "index_rejected", f"recall {recall:.3f} of {kind}")
        generations.activate(folder, kind, str(m["sequence"]), options)
        return recall if queries else 1.0

    def _nearest(self, m: dict):
        active = Generations(self.store, self.definition.name).load().active if self.definition.index != "flat" else None
        if not active or active["kind"] != self.definition.index:
            return None
        since, at = int(active["signature"]), m["snapshot"]
        if at and int(at["name"].split("-")[1]) > since:
            return None  # what changed before the snapshot is no longer told
        changed = [s for s in m["segments"] if int(s["name"].split("-")[1]) > since]
        index = open_index(self.spark, self.store.at(active["folder"]))
        if not changed:
            return index.nearest
        log = self._read(changed)
        touched, fresh = log.select("id").distinct(), mutations.latest(log).filter("vector is not null").select("id", "vector")

        def nearest(vector, k, candidates=None):
            delta = fresh if candidates is None else fresh.join(candidates.select("id"), "id", "left_semi")
            both = index.nearest(vector, k, candidates, touched).unionByName(knn(delta, [(0, vector)], k, self.definition.metric).select("id", "distance"))
            return both.orderBy("distance", "id").limit(k)

        return nearest

    def signature(self) -> str:
        return (signature(self.documents()).first() or [EMPTY_CONTENT])[0]


def by_ids(docs: DataFrame, ids: list[str]) -> DataFrame:
    """Documents of an id list in the order asked for; unknown and repeated ids are skipped. The list is the
    request (at most a page), so it is what is broadcast."""
    wanted = docs.sparkSession.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], "id string, position int")
    return docs.join(F.broadcast(wanted), "id").orderBy("position").drop("position")


def _seal(payload: str) -> str:
    return hashlib.sha256(payload.encode()).hexdigest()[:32]


def page(docs: DataFrame, collection: str, epoch: int, limit: int, offset: int = 0, token: str | None = None) -> tuple[DataFrame, str | None]:
    """(rows by id, token of the next page). The token holds the last id, so a page costs a filter
    and a top-k however deep it is; it is bound to the collection and its epoch."""
    check(limit >= 1 and 0 <= offset <= MAXIMUM_OFFSET, "invalid_limit")
    rows = docs
    if token:
        try:
            name, at, after, seal = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        except ValueError:
            check(False, "invalid_continuation_token")
        check(seal == _seal(json.dumps([name, at, after])) and name == collection and at == epoch, "invalid_continuation_token")
        rows, offset = rows.filter(F.col("id") > after), 0
    part = rows.orderBy("id").offset(offset).limit(limit + 1)
    ids = [r.id for r in part.select("id").collect()]
    out = None
    if len(ids) > limit:
        last = [collection, epoch, ids[limit - 1]]
        out = base64.urlsafe_b64encode(json.dumps([*last, _seal(json.dumps(last))]).encode()).decode().rstrip("=")
    return part.orderBy("id").limit(limit), out


def signature(docs: DataFrame, *columns: str, digits: int | None = None) -> DataFrame:
    """One row (signature): of ids and versions (or ``columns``, for content), for telling whether derived data is stale.

    The SHA-256 of the rows' own SHA-256 in order, by ranges of them: a range has as many leading digits as give about
    4,096 rows a range (or ``digits``), so that no task ever holds all, and the ranges' hashes are hashed again while they
    are many."""
    line = F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string") if c != "metadata" else F.to_json(F.array_sort(F.map_entries(c))), F.lit("\u0001")) for c in columns or ("id", "version")])
    rows = docs.select(F.sha2(line, 256).alias("h"))
    digits = max(0, math.ceil(math.log(max(docs.count(), 1) / 4096, 16))) if digits is None else digits
    while True:
        rows = rows.groupBy(F.substring("h", 1, digits).alias("range")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("x")).select(F.concat("range", "x").alias("h"))
        if not digits:
            return rows.select(F.col("h").alias("signature"))
        digits = max(0, digits - 3)


EMPTY_CONTENT = hashlib.sha256(b"").hexdigest()
CONTENT = ("id", "text", "vector", "metadata", "version")


def digest(rows: DataFrame) -> dict:
    """How many rows, and a sum of their hashes whatever their order."""
    line = F.xxhash64(*[F.col(c).cast("string") if c != "metadata" else F.to_json(F.array_sort(F.map_entries(c))) for c in ("op", "seq", *CONTENT)])
    r = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(line.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    return r.asDict()


class Catalog:
    """Collections by name."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = Store(spark, root)

    def list(self) -> list[str]:
        return [n for n in self.store.list("collections") if self.store.get(f"collections/{n}/definition.json") is not None]

    def create(self, name: str, dimension: int, metric: str = "cosine", index: str = "flat") -> Collection:
        check_collection_name(name)
        check(1 <= dimension <= 65_536, "invalid_dimension")
        check(name not in self.list(), "collection_already_exists", name)
        d = Definition(name, dimension, metric, index, uuid.uuid4().hex, datetime.now(timezone.utc).isoformat())
        self.store.commit(f"collections/{name}/manifests", 0, EMPTY)
        self.store.put(f"collections/{name}/definition.json", json.dumps(d.__dict__).encode())
        return Collection(self.store, d)

    def get(self, name: str) -> Collection:
        data = self.store.get(f"collections/{name}/definition.json")
        check(data is not None, "collection_not_found", name)
        return Collection(self.store, Definition(**json.loads(data)))

    def update(self, name: str, new_name: str | None = None, index: str | None = None) -> Collection:
        """Dimension and metric never change."""
        c = self.get(name)
        c.definition.index = index or c.definition.index
        if new_name and new_name != name:
            check_collection_name(new_name)
            check(new_name not in self.list(), "collection_already_exists", new_name)
            self.store.move(f"collections/{name}", f"collections/{new_name}")
            c.definition.name = new_name
        self.store.put(f"collections/{c.definition.name}/definition.json", json.dumps(c.definition.__dict__).encode())
        return self.get(c.definition.name)

    def delete(self, name: str) -> None:
        self.get(name)
        self.store.move(f"collections/{name}", f"deleted/{name}-{uuid.uuid4().hex[:8]}")

    # backups

    def backup(self, parent: str | None = None) -> str:
        """Every collection's rows under the hash of their content; what is already there is not written again."""
        entries = []
        for name in self.list():
            c = self.get(name)
            content = signature(c.documents(), *CONTENT).first()
            content = content.signature if content else EMPTY_CONTENT
            if not self.store.exists(f"backups/blobs/{content}/_SUCCESS"):
                c.documents().sortWithinPartitions("id").write.mode("overwrite").parquet(self.store.at(f"backups/blobs/{content}"))
            entries.append({"definition": c.definition.__dict__, "blob": content})
        id_ = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:6]}"
        self.store.put_if_absent(f"backups/manifests/{id_}.json", json.dumps({"id": id_, "parent": parent, "collections": entries}).encode())
        return id_

    def backups(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.store.list("backups/manifests") if n.endswith(".json")]

    def _backup(self, id_: str) -> dict:
        data = self.store.read(f"backups/manifests/{id_}.json")
        check(data is not None, "backup_not_found", id_)
        return json.loads(data)

    def verify(self, id_: str) -> bool:
        """Every blob is there and its content has the hash that is its name."""
        held = lambda e: (signature(self._blob(e["blob"]), *CONTENT).first() or [EMPTY_CONTENT])[0]
        return all(self.store.exists(f"backups/blobs/{e['blob']}/_SUCCESS") and held(e) == e["blob"] for e in self._backup(id_)["collections"])

    def _blob(self, digest: str) -> DataFrame:
        return self.store.spark.read.schema(DOCUMENT).parquet(self.store.at(f"backups/blobs/{digest}"))

    def restore(self, id_: str, collection: str | None = None, as_name: str | None = None, overwrite: bool = False) -> list[str]:
        """All collections of a backup, or one, under another name if so; versions are kept."""
        check(self.verify(id_), "backup_corrupted", id_)
        done = []
        for e in self._backup(id_)["collections"]:
            if collection and e["definition"]["name"] != collection:
                continue
            d = Definition(**e["definition"])
            d.name = as_name or d.name
            if d.name in self.list():
                check(overwrite or collection is None, "collection_already_exists", d.name)
                self.delete(d.name)
            self.store.commit(f"collections/{d.name}/manifests", 0, EMPTY)
            self.store.put(f"collections/{d.name}/definition.json", json.dumps(d.__dict__).encode())
            Collection(self.store, d).append(self._blob(e["blob"]).withColumn("op", F.lit("upsert")))
            done.append(d.name)
        check(collection is None or bool(done), "collection_not_found", collection or "")
        return done

    def retain(self, newest: int = 14) -> list[str]:
        """Delete all but the newest backups, and blobs that none refers to; gives the deleted blobs."""
        for id_ in self.backups()[:-newest]:
            self.store.delete(f"backups/manifests/{id_}.json")
        used = {e["blob"] for id_ in self.backups() for e in self._backup(id_)["collections"]}
        gone = [b for b in self.store.list("backups/blobs") if b not in used]
        for b in gone:
            self.store.delete(f"backups/blobs/{b}")
        return gone

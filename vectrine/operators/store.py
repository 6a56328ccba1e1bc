"""Files of any Hadoop file system: small ones that are never seen half written."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from vectrine.schema import check


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        f = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(f))
        finally:
            f.close()

    def _write(self, name: str, data: bytes) -> None:
        f = self._fs.create(self._path(self.at(name)), False)  # fails where it is already there
        f.write(bytearray(data))
        f.close()

    def put(self, name: str, data: bytes) -> None:
        """Write beside and rename into place. The old file stays, under a name of its own, until the new one is there,
        and readers fall back on it."""
        temp, old = f".{uuid.uuid4().hex}", f"{name}.old"
        self._write(temp, data)
        self._fs.mkdirs(self._path(self.at(name)).getParent())
        if self.exists(name):
            self.delete(old)
            check(self._fs.rename(self._path(self.at(name)), self._path(self.at(old))), "storage_error", name)
        check(self._fs.rename(self._path(self.at(temp)), self._path(self.at(name))), "storage_error", name)
        self.delete(old)

    def get(self, name: str) -> bytes | None:
        """What was last put, even if a writer died between its two renames."""
        data = self.read(name)
        return data if data is not None else self.read(f"{name}.old")

    def put_if_absent(self, name: str, data: bytes) -> bool:
        """Whether this call made the file: of two writers one does."""
        try:
            self._write(name, data)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    # numbered manifests

    def commit(self, folder: str, number: int, manifest: dict) -> None:
        """Make manifest ``number``; fails if another writer has."""
        body = json.dumps(manifest)
        sealed = json.dumps({"seal": hashlib.sha256(body.encode()).hexdigest(), "body": body})
        check(self.put_if_absent(f"{folder}/{number:012d}.json", sealed.encode()), "concurrent_write", f"{folder} {number}")

    def latest(self, folder: str) -> tuple[int, dict] | None:
        """(number to commit next, last whole manifest). One that its writer didn't finish doesn't count."""
        names = [n for n in self.list(folder) if n.endswith(".json")]
        for name in reversed(names):
            try:
                m = json.loads(self.read(f"{folder}/{name}") or b"")
            except ValueError:
                continue
            if hashlib.sha256(m["body"].encode()).hexdigest() == m["seal"]:
                return int(names[-1][:12]) + 1, json.loads(m["body"])
        return None

    def prune(self, folder: str, keep: int = 16) -> None:
        for name in [n for n in self.list(folder) if n.endswith(".json")][:-keep]:
            self.delete(f"{folder}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def move(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._path(self.at(to)).getParent())
        check(self._fs.rename(self._path(self.at(name)), self._path(self.at(to))), "storage_error", name)

    def list(self, folder: str = "") -> list[str]:
        p = self._path(self.at(folder) if folder else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

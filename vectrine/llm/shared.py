"""Shared-folder tables and worker set-up used by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.session import BATCH_BYTES as BATCH_BYTES
from vectrine.session import prepare_workers, scratch_dir, shared_dir


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound their batches by bytes, and make sure of the shared folder."""
    shared_dir(spark)
    return prepare_workers(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    It cuts the lineage, survives lost executors, and unlike a checkpoint gives the
    planner the true size, so that it broadcasts only what is really small.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _MADE.append(path)
    return out


#: Paths in the order in which they were written.
_MADE: list[str] = []


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing reads any more."""
    path = _PATHS.pop(df)
    _MADE.remove(path)
    _delete(df.sparkSession, path)


@contextmanager
def only_results(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what :func:`materialise` writes within, but for the tables that are put into the list."""
    first, kept = len(_MADE), []
    yield kept
    keep = {_PATHS[df] for df in kept}
    for path in _MADE[first:]:
        if path not in keep:
            _delete(spark, path)
    _MADE[first:] = sorted(keep)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table that this application wrote; call it when results are stored."""
    _delete(spark, scratch_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def own(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: own(df, id="doc_id")."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` has not yet got."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def keep_rows(docs: DataFrame, drop_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``drop_ids`` (one column); null ids stay."""
    key = free_name(docs, "__drop_id")
    gone = drop_ids.toDF(key)
    return docs.join(gone, docs[f"`{id_col}`"] == gone[key], "left_anti")

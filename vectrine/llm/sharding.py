"""Sharding by jump consistent hashing: no ring table, and appended shards take only their share.

The key's text form is hashed (first 8 bytes of MD5), and the jumps are computed for a whole
Arrow batch at once; only the key travels to Python. When shards grow from n to m, a key
moves with probability 1 - n / m, and then always to one of the new shards.

Defined cases: a null key goes to shard 0; repeated keys, and so repeated rows, go to one shard;
texts are not read; a column that is already called ``shard`` is kept and the new one gets
underscores appended; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.llm.shared import free_name, prepare

SHARDS = 1024


def jump(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard in [0, shards) of each 64-bit key (uint64)."""
    if shards < 1:
        raise ValueError("need at least one shard")
    key = key.astype(np.uint64)
    here, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        here[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (here[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))
        ahead[live] = step.astype(np.int64)
        live = live[ahead[live] < shards]
    return here


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a key column of any type that casts to text."""

    @F.pandas_udf("int")
    def jumped(high: pd.Series, low: pd.Series) -> pd.Series:
        k = high.to_numpy(np.int64).astype(np.uint64) << np.uint64(32) | low.to_numpy(np.int64).astype(np.uint64)
        return pd.Series(jump(k, shards).astype(np.int32), index=high.index)

    digest = F.md5(key.cast("string").cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return F.when(key.isNull(), F.lit(0)).otherwise(jumped(F.coalesce(half(1), F.lit(0)), F.coalesce(half(9), F.lit(0))))


def shard(docs: DataFrame, shards: int = SHARDS, key_col: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``shard``."""
    prepare(docs.sparkSession)
    return docs.withColumn(free_name(docs, "shard"), shard_of(F.col(f"`{key_col}`"), shards))

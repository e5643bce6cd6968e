"""Jump consistent hashing: a key's shard from arithmetic alone, with no ring table.

When shards are appended, from n to n + k, a key either stays or moves to one of the new shards; k / (n + k) of them move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key64
from .textkit import U, raw

STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys jump together until the last has left the range."""
    keys = keys.astype(U, copy=True)
    shard = np.zeros(len(keys), np.int64)
    live, at = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(live):
        shard[live] = at
        keys = keys * U(STEP) + U(1)
        at = ((at + 1) * (2147483648.0 / ((keys >> U(33)) + U(1)).astype(np.float64))).astype(np.int64)
        more = at < shards
        live, keys, at = live[more], keys[more], at[more]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard in [0, shards) of a column's text. A null key counts as the empty text."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.arrow_udf("int")
    def shard(keys: pa.Array) -> pa.Array:
        return pa.array(jump(np.frombuffer(raw(keys)[0], ">u8"), shards).astype(np.int32))

    return shard(key64(key))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """The input with the column ``shard``, replacing any column of that name.

    Nothing is shuffled. Equal keys, and so repeated rows, share a shard; all null keys share the empty text's. Every
    other column is passed on as it is, null or not; an empty table stays empty.
    """
    return docs.withColumn(shard, shard_of(F.col(key), shards))


def shards_sql(shards: int) -> str:
    nxt = f"(key * {STEP} + 1) % 18446744073709551616"
    return f"""
WITH RECURSIVE keys AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT)::HUGEINT AS key FROM documents),
jumps AS (
  SELECT doc_id, key, -1::BIGINT AS shard, 0::BIGINT AS goes FROM keys
  UNION ALL
  SELECT doc_id, nxt, goes, CAST(floor((goes + 1) * (2147483648.0::DOUBLE / ((nxt // 8589934592) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT *, {nxt} AS nxt FROM jumps WHERE goes < {shards})
)
SELECT doc_id, shard::INTEGER AS shard FROM jumps WHERE goes >= {shards}"""

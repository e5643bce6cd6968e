"""Blocked Bloom filter: a key's bits, eight at most, lie in one 256-bit block, so that a test touches one cache line.

The filter is built in place by block range, one exchange of hashes. Its size follows the number of keys up to a bound
that makes it safe to broadcast; from there on its blocks hold more keys each and a key sets fewer bits, so that it
passes more as lists grow. It never loses a key, and the exact join that follows every use removes what it passed wrongly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, partitions, share
from .textkit import U

SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
BITS_A_KEY = 16
MOST_BYTES = 64 << 20


def place(hashes: np.ndarray, blocks: int, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(block, masks of its eight words) of 64-bit hashes: a bit in each word, or ``bits`` fewer anywhere in the block."""
    hashes = hashes.view(U)
    block = ((hashes >> U(32)) * U(blocks) >> U(32)).astype(np.int64)
    spots = hashes.astype(np.uint32)[:, None] * SALTS[:bits]
    if bits == 8:
        return block, np.uint32(1) << (spots >> np.uint32(27))
    masks = np.zeros((len(hashes), 8), np.uint32)
    at = np.arange(len(hashes))
    for k in range(bits):
        masks[at, spots[:, k] >> np.uint32(29)] |= np.uint32(1) << (spots[:, k] >> np.uint32(24) & np.uint32(31))
    return block, masks


class BlockedBloom:
    def __init__(self, words: np.ndarray, bits: int = 8):
        self.words, self.bits = words.reshape(-1, 8), bits

    @classmethod
    def of(cls, hashes: np.ndarray, blocks: int, bits: int = 8) -> BlockedBloom:
        words = np.zeros((blocks, 8), np.uint32)
        block, masks = place(hashes, blocks, bits)
        for k in range(8):
            np.bitwise_or.at(words[:, k], block, masks[:, k])
        return cls(words, bits)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), bool)
        block, masks = place(hashes, len(self.words), self.bits)
        return ((self.words[block] & masks) == masks).all(axis=1)


def build(keys: DataFrame, key: str, most_bytes: int = MOST_BYTES, hashed: bool = False) -> BlockedBloom:
    """Filter of a column's distinct keys, of ``most_bytes`` at most. hashed: the column holds 64-bit hashes already."""
    spark = keys.sparkSession
    hashes = keys.filter(F.col(key).isNotNull()).select((F.col(key) if hashed else F.xxhash64(F.col(key))).alias("h"))
    count = hashes.count()
    if count == 0:
        return BlockedBloom(np.zeros((0, 8), np.uint32))
    blocks = max(1, min(-(-count * BITS_A_KEY // 256), most_bytes // 32))
    bits = max(1, min(8, round(0.55 * blocks * 256 / count)))
    parts = min(partitions(spark), blocks)

    def fill(batches):
        held = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if held:
            block, masks = place(np.concatenate(held), blocks, bits)
            at, inverse = np.unique(block, return_inverse=True)
            words = np.zeros((len(at), 8), np.uint32)
            for k in range(8):
                np.bitwise_or.at(words[:, k], inverse, masks[:, k])
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary())], ["at", "words"])

    part = F.floor(F.shiftrightunsigned("h", 32) * F.lit(parts) / F.lit(1 << 32)).cast("int")
    words = np.zeros((blocks, 8), np.uint32)
    for row in arrow(hashes.repartitionById(parts, part), fill, "at binary, words binary").toLocalIterator():
        words[np.frombuffer(row["at"], np.int64)] |= np.frombuffer(row["words"], np.uint32).reshape(-1, 8)
    return BlockedBloom(words, bits)


def may_hold(spark: SparkSession, bloom: BlockedBloom, key: Column) -> Column:
    """Whether the filter may hold a key; it holds no null."""
    shared = share(spark, bloom)

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(shared().test(hashes.to_numpy()))

    return key.isNotNull() & test(F.xxhash64(key))

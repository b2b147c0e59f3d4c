"""Bloom filters of long columns: a bitmap of bounded size, built by Spark's bitmap aggregates.

A filter only saves shuffling rows that have no partner; the join after it decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 28  # 32 MB, whatever the number of keys
PAGE = 32768  # bits of one bitmap of Spark's aggregate


class Bloom:
    def __init__(self, bits: int, bitmap: np.ndarray):
        self.bits, self.bitmap = bits, bitmap

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in places(keys.view(np.uint64), self.bits):
            out &= (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def places(keys: np.ndarray, bits: int):
    """Two bits of a hashed key: its low and its high half."""
    yield (keys & np.uint64(bits - 1)).astype(np.int64)
    yield ((keys >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def build(df: DataFrame, column: str, n: int) -> Bloom:
    """Filter of the column's longs (already well mixed hashes); n: about how many there are."""
    bits = PAGE
    while bits < MOST_BITS and bits < 12 * n:
        bits *= 2
    low = F.col(column).bitwiseAND(F.lit(bits - 1).cast("long"))
    high = F.shiftrightunsigned(F.col(column), 32).bitwiseAND(F.lit(bits - 1).cast("long"))
    at = df.select(F.explode(F.array(low, high)).alias("at")).withColumn("at", F.col("at") + 1)
    pages = (at.groupBy(F.bitmap_bucket_number("at").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in pages:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bitmap[(r.page - 1) * (PAGE // 8):][:len(part)] = part
    return Bloom(bits, bitmap)

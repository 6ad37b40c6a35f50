"""A Bloom filter of fixed size over 64-bit hashes.

Built by Spark's bitmap aggregates, it reaches the driver and the tasks as
``2 ** BITS`` bits (8 MB) whatever the data; with more keys it lets more
through and never drops one, so an exact join may follow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26
MASK = (1 << BITS) - 1
BITMAP = 4096  # bytes of one of Spark's bitmaps


def bloom_filter(keys: DataFrame, key: Column) -> np.ndarray:
    """The filter of ``key`` (long) as packed bits."""
    probes = F.array(key.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(key, BITS).bitwiseAND(F.lit(MASK)))
    at = keys.select(F.explode(probes).alias("p")).select((F.col("p") + 1).alias("p"))
    maps = (
        at.groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect())
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in maps:
        lo = (r["bucket"] - 1) * BITMAP
        out[lo:lo + BITMAP] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of the ``keys`` (int64) that the filter may hold."""
    keys = keys.view(np.uint64)
    found = np.ones(len(keys), bool)
    for p in (keys & np.uint64(MASK), (keys >> np.uint64(BITS)) & np.uint64(MASK)):
        p = p.astype(np.int64)
        found &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return found

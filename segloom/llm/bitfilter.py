"""Bit arrays that keep keys which have no partner out of a shuffle.

A filter is sized by the number of its keys, 16 bits or more each, up to MOST_BITS. Beyond
that it fills up and holds fewer keys back; it never drops a key it was built from, so results
don't depend on its size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 16 MB, and at most so many 64-bit words / 64 on the driver.
MOST_BITS = 1 << 27


class BitFilter:
    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (int64) may have been among those of the filter."""
        if not len(keys):
            return np.zeros(0, bool)
        slot = keys.view(np.uint64) & np.uint64(64 * len(self.words) - 1)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits_for(count: int) -> int:
    """A power of two: 16 bits for each key, at least 2^16 and at most MOST_BITS."""
    return min(MOST_BITS, max(1 << 16, 1 << (16 * max(1, count) - 1).bit_length()))


def build(keys: DataFrame, key: Column | str, count: int | None = None):
    """Broadcast filter of the 64-bit keys; `count` is their number, if it is known."""
    spark = keys.sparkSession
    rows = keys.select((F.col(key) if isinstance(key, str) else key).alias("key"))
    bits = bits_for(rows.count() if count is None else count)
    slot = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = rows.groupBy(F.shiftrightunsigned(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("b"))
    got = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(BitFilter(out))

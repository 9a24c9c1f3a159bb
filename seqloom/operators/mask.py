"""A table of bits, of one size whatever is put in, that tells tasks which keys nobody asks for."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits, a prime just below 2^24 (2 MB); bits that Spark's bitmaps hold each.
BITS, EACH = 16_777_213, 1 << 15


class Mask:
    """has() is true of every key that was put in, and of few others as long as the table is mostly empty."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys % keys.dtype.type(BITS)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def __reduce__(self):
        return _unpacked, (zlib.compress(self.bits.tobytes(), 1),)


def _unpacked(packed: bytes) -> Mask:
    return Mask(np.frombuffer(zlib.decompress(packed), np.uint8))


def mask(rows: DataFrame, key: Column) -> Mask | None:
    """The mask of the keys (bigint) of some rows; none if it would be half full."""
    at = rows.select(F.pmod(key.cast("bigint"), F.lit(BITS)).alias("at"))
    by = at.groupBy(F.floor(F.col("at") / EACH).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % EACH).alias("bits"))
    bits = np.zeros(-(-BITS // EACH) * EACH // 8, np.uint8)
    for r in by.collect():
        bits[r.part * EACH // 8 :][: EACH // 8] = np.frombuffer(r.bits, np.uint8)
    return Mask(bits) if int(np.bitwise_count(bits).sum()) * 2 <= BITS else None

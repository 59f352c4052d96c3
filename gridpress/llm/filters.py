"""A filter of fixed size that tells tasks which 64-bit keys a table may hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter; its size does not depend on the data.
FILTER_BITS = 1 << 26
#: Fixed value: bits of one of Spark's bitmaps.
BITMAP_BITS = 32768


def filter_of(keys: DataFrame, both: bool = False) -> bytes:
    """Bits of the keys (column key, bigint) that are in a table; passes FILTER_BITS / 8 bytes to the driver.

    With ``both``, a key sets a second bit from its upper half, as ``may_hold``
    asks for: keys that are hashes are then rarely let through by chance.
    """
    low = F.pmod("key", F.lit(FILTER_BITS))
    high = F.pmod(F.shiftrightunsigned("key", 32), F.lit(FILTER_BITS))
    one = (F.explode(F.array(low, high)) if both else low).alias("slot")
    slots = keys.select(one).select((F.col("slot") + 1).alias("one"))  # Spark's bitmaps count from one
    maps = slots.groupBy(F.bitmap_bucket_number("one").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("one")).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for bucket, chunk in maps.collect():
        at = (bucket - 1) * BITMAP_BITS // 8
        bits[at : at + len(chunk)] = chunk
    return bytes(bits)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned keys the table of a filter with ``both`` bits may hold; never False for one that it holds."""
    out = np.ones(len(keys), bool)
    for part in (keys, keys >> np.uint64(32)):
        slot = (part & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        out &= (bits[slot >> 3] >> (slot & 7)) & 1 == 1
    return out

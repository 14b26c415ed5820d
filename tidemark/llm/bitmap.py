"""Bitmaps of hashed keys: what surely is no key is dropped before an exact join.

A bitmap has 16 bits for each key, and never more than `2 ** BITS_MOST` (64 MB), so it may
be broadcast at any size; more keys only let more through, and the join that follows decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_MOST = 29
BLOCK_BITS = 6  # the bitmap is built in so many bits' worth of blocks


def build(hashes: DataFrame) -> Broadcast:
    """Bitmap of the well mixed 64-bit hashes in the column `h` of a stored table."""
    bits = min(max(16 * hashes.count(), 1 << 12).bit_length(), BITS_MOST)

    def fill(table: pa.Table) -> pa.Table:
        place = table.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        own = bits - BLOCK_BITS
        flags = np.zeros(1 << own, dtype=bool)
        flags[(place & np.uint64((1 << own) - 1)).astype(np.int64)] = True
        return pa.table({"block": pa.array([int(place[0]) >> own], pa.int32()), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    keyed = hashes.select(F.shiftrightunsigned("h", 64 - BLOCK_BITS).cast("int").alias("block"), "h")
    blocks = keyed.groupBy("block").applyInArrow(fill, schema="block int, flags binary").collect()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    size = len(out) >> BLOCK_BITS
    for b in blocks:
        out[b["block"] * size : (b["block"] + 1) * size] = np.frombuffer(b["flags"], dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def maybe(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be keys of the bitmap."""
    bits = len(flags).bit_length() + 2
    place = hashes >> np.uint64(64 - bits)
    return (flags[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

"""A Bloom filter of bounded size over 64-bit hashes, built by Spark and tested in numpy.

It only spares rows before an exact join: what it lets through by chance, the join drops,
and beyond its largest size it lets more through, never less."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smallest and largest size in bits.
BITS = (1 << 20, 1 << 28)


def build(hashes: DataFrame, column: str, n: int, bits_per_hash: int) -> np.ndarray:
    """The filter of ``n`` hashes (long), as bytes: two bits per hash."""
    bits = 1 << max(BITS[0] - 1, min(BITS[1], n * bits_per_hash) - 1).bit_length()
    h = F.col(column)
    place = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))))
    words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
                 ).alias("word"))
    t = words.toArrow()  # at most bits / 64 rows of 12 bytes: 50 MB for the largest filter
    out = np.zeros(bits // 64, dtype="<i8")
    out[t["at"].to_numpy()] = t["word"].to_numpy()
    return out.view(np.uint8)


def might_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in ``hashes`` (uint64) that the filter does not refute."""
    mask = np.uint64(len(table) * 8 - 1)
    one = hashes & mask
    hit = np.flatnonzero(table[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1)
    two = (hashes[hit] >> np.uint64(32)) & mask
    return hit[(table[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]

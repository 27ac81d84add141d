"""MurmurHash3 (x86, 128 bits, seed 0) of 64-bit keys: the low half, vectorised.

Spark's own ``hash`` is the 32-bit variant and not interchangeable with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published hash function.
C1, C2, C3 = 0x239B961B, 0xAB0E9789, 0x38B34AE5
M1, M2 = 0x85EBCA6B, 0xC2B2AE35


def _rotate(v: np.ndarray, by: int) -> np.ndarray:
    return (v << np.uint32(by)) | (v >> np.uint32(32 - by))


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint32(16))) * np.uint32(M1)
    v = (v ^ (v >> np.uint32(13))) * np.uint32(M2)
    return v ^ (v >> np.uint32(16))


def murmur_low64(keys: np.ndarray) -> np.ndarray:
    """Low 64 bits of the hash of the little-endian bytes of uint64 keys."""
    keys = keys.astype(np.uint64)
    low, high = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        size = np.uint32(8)
        # an 8-byte key is all tail: its words enter the first two of four lanes
        h1 = (_rotate(low * np.uint32(C1), 15) * np.uint32(C2)) ^ size
        h2 = (_rotate(high * np.uint32(C2), 16) * np.uint32(C3)) ^ size
        h3 = h4 = np.full_like(h1, size)
        h1 = h1 + h2 + h3 + h4
        h2, h3, h4 = h2 + h1, h3 + h1, h4 + h1
        h1, h2, h3, h4 = map(_mix, (h1, h2, h3, h4))
        h1 = h1 + h2 + h3 + h4
        h2 = h2 + h1
    return (h2.astype(np.uint64) << np.uint64(32)) | h1.astype(np.uint64)


def murmur(key: Column) -> Column:
    """The hash of a bigint column as the bigint with the same bits."""

    @F.pandas_udf("bigint")
    def run(keys: pd.Series) -> pd.Series:
        on = keys.notna()
        out = pd.Series([None] * len(keys), dtype="Int64")
        out[on.to_numpy()] = murmur_low64(keys[on].to_numpy(np.int64).view(np.uint64)).view(np.int64)
        return out

    return run(key)

"""Bit arrays of fixed size that tell tasks which keys are worth sending on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_filter(keys: DataFrame, key: Column, bits: int) -> np.ndarray:
    """A bit for each value of ``key`` (a well-mixed long): 2^bits bits, however many rows there are.

    A full filter lets everything through, so whoever uses it has to decide exactly afterwards.
    """
    place = keys.select(F.shiftrightunsigned(key, 64 - bits).alias("i"))
    found = (place.groupBy(F.shiftright("i", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(i & 63 AS INT))")).alias("b")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def in_filter(filter_bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where the bit of an unsigned 64-bit key is set."""
    bits = int(len(filter_bits)).bit_length() + 5
    i = keys >> np.uint64(64 - bits)
    return (filter_bits[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)

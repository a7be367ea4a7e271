"""A bit for each slot of a set of keys: of fixed size, so it may go to every task. It spares work and decides nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

SLOTS = 1 << 22


def bitmap_of(keys: DataFrame, column: str) -> bytes:
    """Packed bits (little end first) of the lowest bits of a long column; at most SLOTS / 32 rows are fetched."""
    slot = F.col(column).bitwiseAND(SLOTS - 1)
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 as int)))").alias("bits"))
    out = np.zeros(SLOTS // 32, np.uint32)
    for w, bits in words.collect():
        out[w] = bits
    return out.tobytes()


def as_flags(packed: bytes) -> np.ndarray:
    """One boolean per slot."""
    return np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)

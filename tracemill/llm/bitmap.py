"""Bitmaps of a fixed size that spare a shuffle most rows without a partner."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

# 2^26 bits are 8 MB, whatever is put in. A full bitmap lets everything through.
BITS = 26


def bitmap(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Marks the low bits of a hashed long column. At most 2^(bits-6) words reach the driver."""
    cell = f"({column} & {(1 << bits) - 1}L)"
    words = df.select(F.expr(f"shiftright({cell}, 6)").alias("word"), F.expr(
        f"shiftleft(1L, cast({cell} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    table = words.toArrow()
    found = np.zeros(1 << (bits - 6), np.uint64)
    found[table.column("word").to_numpy()] = table.column("bit").to_numpy().view(np.uint64)
    return found


def listed(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the longs may have been put in: true for all that were."""
    bits = int(np.log2(len(found))) + 6
    cells = values.view(np.uint64) & np.uint64((1 << bits) - 1)
    return (found[cells >> np.uint64(6)] >> (cells & np.uint64(63))) & np.uint64(1) == 1

"""A bitset of 64-bit ids with a size that does not depend on the data.

It goes to every task ahead of a join and keeps most rows without a partner from being
shuffled. Ids that share a bit with a member pass too, so the join itself stays exact;
when there are so many members that all bits are set, it merely filters nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27


def bitset(ids: DataFrame) -> np.ndarray:
    """Bits ``id mod BITS`` of a column ``id`` of longs: ``BITS / 8`` bytes."""
    at, word = F.expr(f"cast(shiftright(id & {BITS - 1}L, 6) AS int)"), F.expr("bit_or(shiftleft(1L, cast(id & 63L AS int)))")
    words = ids.groupBy(at.alias("at")).agg(word.alias("word")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the signed ids may be members."""
    at = ids.astype(np.int64) & (BITS - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

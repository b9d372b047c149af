"""Lookup joins that hold up when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dictionary of at most so many rows is replicated; the number is checked, not believed.
REPLICATED_ROWS = 100_000


def is_small(right: DataFrame, rows: int = REPLICATED_ROWS) -> bool:
    """Whether a dictionary has at most ``rows`` rows; reads no more than one row beyond."""
    return right.limit(rows + 1).count() <= rows


def lookup(left: DataFrame, right: DataFrame, key: str, bounded: bool = False) -> DataFrame:
    """Left join to a dictionary with one row per key.

    ``left`` should hold distinct (unit, key) pairs.  A hot key's rows are split by the session's
    adaptive skew join, because the other side has one row for it; nothing is repeated in advance.
    With ``bounded`` the dictionary is broadcast if its size, which is checked, allows it.
    """
    if bounded and is_small(right):
        return left.join(F.broadcast(right), key, "left")
    return left.join(right, key, "left")

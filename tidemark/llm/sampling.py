"""Bounded samples in two steps, so that no task sends more than its share to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 64


def bound(total: int, n: int) -> int:
    """How many of the 2**64 hashes to keep, so that somewhat more than `n` of `total` rows are left."""
    wanted = n + n // 5 + 1000
    return SPAN if total <= wanted else SPAN * wanted // total


def smallest(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """The `n` rows with the smallest hashes of `key`; of many rows, only those below a bound are sorted."""
    h = F.xxhash64(*key)
    most = bound(rows.count(), n) - SPAN // 2 - 1
    return rows.where(h <= F.lit(most)).orderBy(h, *key).limit(n)

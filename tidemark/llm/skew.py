"""Joins to a side with unique keys, where one key may hold any share of the other side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .exchange import materialise

HEAVY = 1_000
FLOOR = 20_000


def heavy_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with more than one in `HEAVY` of the rows, so fewer than `HEAVY`; none if the rows are few for one task.

    `rows` is read twice, as counts that are pre-aggregated before their shuffle.
    """
    total = rows.count()
    if total <= FLOOR:
        return None
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > total / HEAVY)
    found = materialise(counted.dropna(subset=keys).select(*keys), "heavy")
    return None if found.isEmpty() else found


def heaviest(counted: DataFrame, n: str) -> list[Row]:
    """The same of a stored table with one row for each key and its number of rows `n`: fewer than `HEAVY` of its rows."""
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    return [] if total <= FLOOR else counted.where(F.col(n) > total / HEAVY).collect()


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", heavy: DataFrame | None = None) -> DataFrame:
    """`left` with the columns of the one row of `right` that has its keys.

    Rows of heavy keys stay where they are and meet a broadcast of fewer than `HEAVY`
    rows of `right`; null keys meet nothing and are not shuffled; the others join.
    `left` is read once for each of these, so it should be a stored table.
    """
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    light, parts = left.where(whole), []
    if heavy is not None:
        known = materialise(right.join(F.broadcast(heavy), keys, "left_semi"), "heavy")
        hot = left if how == "inner" else left.join(F.broadcast(heavy), keys, "left_semi")
        parts.append(hot.join(F.broadcast(known), keys, how))
        light = light.join(F.broadcast(heavy), keys, "left_anti")
    parts.append(light.join(right, keys, how))
    if how == "left":
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys]
        parts.append(left.where(~whole).select(*keys, *(c for c in left.columns if c not in keys), *others))
    return reduce(DataFrame.unionByName, parts)

"""Connected components of an edge table, as a few rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import discard, materialise
from .skew import heavy_keys, lookup


def _roots(pairs: DataFrame) -> DataFrame:
    """Stored (node, root): each node points to its least neighbour if that is smaller, and pointers are followed to their end."""
    ends = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    roots = materialise(ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "roots")
    while True:
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = lookup(roots, up, ["root"], "inner", heavy_keys(roots, ["root"]))
        moved = materialise(moved.select("node", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("changed")), "roots")
        discard(roots)
        roots = moved.select("node", "root")
        if moved.where("changed").isEmpty():
            return roots


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node is connected with.

    Each round replaces nodes by roots of trees of least neighbours and keeps the edges between
    different roots, each once, so that edges within what is joined already are read in one
    round only.  A root that took no neighbour has a smaller one in the next round, so two
    rounds at least halve what is left.  Edges of a hub, and nodes of one root, meet its label
    in a bounded broadcast, so that no task holds a hub; minima are pre-aggregated before
    their shuffle.  Every round is written to the shared folder, and the round before it
    deleted.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = materialise(given.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    for _ in range(max_rounds):
        roots = _roots(pairs)
        first, second = (roots.select(F.col("node").alias(e), F.col("root").alias(f"{e}_root")) for e in "uv")
        half = materialise(lookup(pairs, first, ["u"], "inner", heavy_keys(pairs, ["u"])).select("v", F.col("u_root").alias("u")), "half")
        both = lookup(half, second, ["v"], "inner", heavy_keys(half, ["v"])).select("u", F.col("v_root").alias("v")).where("u <> v")
        left = materialise(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            named = materialise(lookup(labels, up, ["root"], "left", heavy_keys(labels, ["root"])).select("node", F.coalesce("up", "root").alias("root")), "labels")
            discard(labels)
            discard(roots)
            labels = named
        discard(half)
        discard(pairs)
        pairs = left
        if pairs.isEmpty():
            discard(pairs)
            return labels.select("node", F.col("root").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

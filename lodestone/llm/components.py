"""Connected components by alternating large-star and small-star joins (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .arrays import cut, drop_table


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, and a fingerprint of their set that is taken while they are written."""
    seen = Observation()
    table = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % (1 << 20)).alias("s")), name)
    got = seen.get
    return table, (got["n"], got["x"], got["s"])


def connected_components(edges: DataFrame, name: str = "cc", most: int = 40) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Rounds grow with the logarithm of the size; each round is one job, written to the shared folder,
    and the last two are alike. Nothing but the fingerprint of a round comes to the driver. Empty
    edges give no rows; loops are ignored.
    """
    now, mark = _written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(most):
        if not mark[0]:
            break
        # large star: each neighbour above the node is hung on the smallest neighbour (itself included)
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: each neighbour below, and the node, are hung on the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        before, old = now, mark
        now, mark = _written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        drop_table(before)
        if mark == old:  # nothing moves once every node hangs on its root
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), name)
    drop_table(now)
    return out

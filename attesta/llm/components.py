"""Connected components by large-star and small-star rounds.

Each round is an aggregate (the smallest neighbour of a node, combined before the shuffle)
and a join; a node with very many links is never gathered. Rounds are written to the shared
folder, so a lost executor costs its part of one round. The number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (a, b). `small`: only neighbours below the node move."""
    if small:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("least"))
    if small:
        linked = around.join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b"))
        own = least.select(F.col("u").alias("a"), F.col("least").alias("b"))
        moved = linked.union(own)
    else:
        moved = (around.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("a"), F.least("least", "u").alias("b")))
    return moved.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node reached.

    Loops, repeated edges and edges in either direction make no difference; edges with a null
    end are dropped. No edges give an empty result. Runs jobs while it is built.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()
    edges = materialize(edges, "edges")
    sign = _sign(edges)
    while sign[0]:
        edges = materialize(_star(_star(edges, small=False), small=True), "edges")
        before, sign = sign, _sign(edges)
        if sign == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _sign(edges: DataFrame) -> tuple:
    """Edge count and two order-free digests; equal ones mean that nothing moved."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                    F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)

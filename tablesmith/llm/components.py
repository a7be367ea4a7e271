"""Connected components of an edge table by repeated contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the roots are arbitrary but equal within a component.

    Each round every vertex points at its smallest neighbour and the edges are contracted along the pointers.
    Vertices are hashes, so "smallest" is a random choice and a constant share of them vanishes each round.
    """
    edges = edges.filter("a <> b").distinct()
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(both.groupBy("a").agg(F.min("b").alias("p")).selectExpr("a as node", "least(a, p) as root"), "parents")
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = stored(labels.join(up, "root", "left").selectExpr("node", "coalesce(top, root) as root"), "labels")
        left = parents.selectExpr("node as a", "root as ra")
        right = parents.selectExpr("node as b", "root as rb")
        edges = stored(edges.join(left, "a").join(right, "b").filter("ra <> rb").selectExpr("least(ra, rb) as a", "greatest(ra, rb) as b").distinct(), "edges")
        if edges.isEmpty():
            return labels

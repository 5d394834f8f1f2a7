"""Connected components over an edge table, by contraction with pointer jumping.

Every round each vertex points at its smallest neighbour, pointers are followed to
their ends by repeated squaring, edges are relabelled, and loops vanish; the number
of vertices at least halves.  All state stays in checkpointed tables; the driver only
sees counts.  A star around one hot vertex is gone after one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _ends(parent: DataFrame) -> DataFrame:
    """Follow (v, to) to the last vertex."""
    while True:
        a, b = parent.alias("a"), parent.alias("b")
        step = a.join(b, F.col("a.to") == F.col("b.v"), "left").select(
            "a.v", F.coalesce("b.to", "a.to").alias("to"), (F.col("b.to") < F.col("a.to")).alias("moved")
        )
        step = cut(step)
        if not step.where("moved").head(1):
            return step.select("v", "to")
        parent = step.select("v", "to")


def components(edges: DataFrame) -> DataFrame:
    """(v, component) with component the smallest vertex reachable, for every vertex with an edge.

    edges: two long columns a, b; repeated edges and loops are allowed.
    """
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = cut(edges.where("a <> b").select(lo, hi).distinct())
    labels = None
    while edges.head(1):
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("to")))
        parent = both.groupBy("v").agg(F.min("to").alias("to")).select("v", F.least("v", "to").alias("to"))
        parent = _ends(cut(parent))
        if labels is None:
            labels = parent
        else:
            la, p = labels.alias("l"), parent.alias("p")
            labels = cut(la.join(p, F.col("l.to") == F.col("p.v"), "left").select("l.v", F.coalesce("p.to", "l.to").alias("to")))
        p, q = parent.alias("p"), parent.alias("q")
        half = edges.join(p, F.col("b") == F.col("p.v")).where(F.col("a") != F.col("p.to")).select("a", F.col("p.to").alias("b"))
        moved = half.join(q, F.col("a") == F.col("q.v")).select(F.col("q.to").alias("a"), "b").where("a <> b")
        edges = cut(moved.select(lo, hi).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return labels.select("v", F.col("to").alias("component"))

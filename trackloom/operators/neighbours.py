"""Pairs of close objects, and of overlapping boxes, within a frame, as equi-joins over a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G

FRAME = ("sequence_id", "frame_id")


def within(a: DataFrame, b: DataFrame, reach: float, columns: tuple[str, ...], frame: tuple[str, ...] = FRAME) -> DataFrame:
    """(sequence_id, frame_id, a_..., b_..., distance): rows of ``a`` and ``b`` of one frame no further apart than ``reach``.

    The frame is cut into cells as wide as the reach.  Each row of ``b`` goes to the nine cells
    around it and meets only the rows of ``a`` in them, so a crowded frame costs its close
    pairs, not all its pairs.  The sides are merged, never broadcast: nine copies of each row of a
    compressed file are far larger than the file, by which the planner would choose.  ``columns`` are carried along besides cx and cy; ``frame`` names
    a frame's columns (streams add the event time, so that their join can forget old frames).
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    names = tuple(dict.fromkeys(("cx", "cy", *columns)))
    left = a.select(*frame, cell("cx").alias("gx"), cell("cy").alias("gy"), *(F.col(c).alias(f"a_{c}") for c in names))
    nine = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    right = b.select(*frame, cell("cx").alias("hx"), cell("cy").alias("hy"), *(F.col(c).alias(f"b_{c}") for c in names), nine.alias("n"))
    right = right.select(*frame, (F.col("hx") + F.col("n.i")).alias("gx"), (F.col("hy") + F.col("n.j")).alias("gy"), *(f"b_{c}" for c in names))
    pairs = left.join(right.hint("merge"), [*frame, "gx", "gy"]).drop("gx", "gy")
    distance = G.distance(*(F.col(c) for c in ("a_cx", "a_cy", "b_cx", "b_cy")))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= reach)


BOX = ("x1", "y1", "x2", "y2")


def overlapping(a: DataFrame, b: DataFrame, cell: float, columns: tuple[str, ...], keys: tuple[str, ...] = FRAME) -> DataFrame:
    """(keys, a_..., b_..., for ``columns`` and boxes): rows of ``a`` and ``b`` with equal keys whose boxes share some area.

    A box goes to every cell that it touches, so only boxes that come near meet; a pair counts in
    the one cell that holds the corner of its overlap with the smallest coordinates.  ``cell`` should be
    about the size of a usual box; a box of w times h costs about (w / cell + 1) * (h / cell + 1) rows.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    names = tuple(dict.fromkeys((*BOX, *columns)))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        own = df.where("x1 < x2 and y1 < y2").select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in names))
        along = own.withColumn("gx", F.explode(F.sequence(at(F.col(f"{side}_x1")), at(F.col(f"{side}_x2")))))
        return along.withColumn("gy", F.explode(F.sequence(at(F.col(f"{side}_y1")), at(F.col(f"{side}_y2")))))

    pairs = dealt(a, "a").join(dealt(b, "b").hint("merge"), [*keys, "gx", "gy"])
    left, top = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    share = (left < F.least("a_x2", "b_x2")) & (top < F.least("a_y2", "b_y2"))
    return pairs.where(share & (at(left) == F.col("gx")) & (at(top) == F.col("gy"))).drop("gx", "gy")

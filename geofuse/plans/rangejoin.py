"""Range joins by bucket: both sides are put into cells of a lattice, and meet there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, box: tuple[str, str, str, str], cell: float = 1.0) -> DataFrame:
    """Points with the boxes (west, south, east, north) that hold them, edges included."""
    w, s, e, n = (F.col(c) for c in box)
    b = boxes.filter((w <= e) & (s <= n)).withColumn("__cx", _cells(w, e, cell)).withColumn("__cy", _cells(s, n, cell))
    p = points.withColumns({"__cx": F.floor(F.col(x) / cell), "__cy": F.floor(F.col(y) / cell)})
    met = p.join(b, ["__cx", "__cy"])
    return met.filter((F.col(x) >= w) & (F.col(x) <= e) & (F.col(y) >= s) & (F.col(y) <= n)).drop("__cx", "__cy")


def boxes_that_meet(a: DataFrame, b: DataFrame, box_a: tuple[str, str, str, str], box_b: tuple[str, str, str, str], cell: float = 4.0) -> DataFrame:
    """Pairs of boxes that intersect, each pair once: in the cell of the intersection's south-west corner."""
    (aw, as_, ae, an), (bw, bs, be, bn) = (tuple(F.col(c) for c in box) for box in (box_a, box_b))
    left = a.withColumn("__cx", _cells(aw, ae, cell)).withColumn("__cy", _cells(as_, an, cell))
    right = b.withColumn("__cx", _cells(bw, be, cell)).withColumn("__cy", _cells(bs, bn, cell))
    met = left.join(right, ["__cx", "__cy"]).filter((aw <= be) & (bw <= ae) & (as_ <= bn) & (bs <= an))
    once = (F.col("__cx") == F.floor(F.greatest(aw, bw) / cell)) & (F.col("__cy") == F.floor(F.greatest(as_, bs) / cell))
    return met.filter(once).drop("__cx", "__cy")

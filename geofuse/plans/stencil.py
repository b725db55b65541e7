"""Neighbourhoods of cells of a grid, one axis at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stencil(cells: DataFrame, grid: list[str], value: str, radius: int, kind: str, out: str, dense: bool = False) -> DataFrame:
    """min, max, sum or mean of the cells up to radius away on both axes; cells outside and missing ones don't count.

    A dense grid takes two windows. Where cells may be missing, each cell is handed to its neighbours on one
    axis, combined, then on the other: 2 * (2 * radius + 1) rows a cell, added up map-side.
    """
    f = {"min": F.min, "max": F.max, "sum": F.sum, "mean": F.sum}[kind]
    if dense and kind != "mean":
        along_row = Window.partitionBy(*grid, "row").orderBy("col").rangeBetween(-radius, radius)
        along_col = Window.partitionBy(*grid, "col").orderBy("row").rangeBetween(-radius, radius)
        return cells.withColumn("__a", f(value).over(along_row)).withColumn(out, f("__a").over(along_col)).drop("__a")
    part = cells.select(*grid, "row", "col", F.col(value).alias("__v"), F.col(value).isNotNull().cast("long").alias("__n"))
    for axis in ("col", "row"):
        spread = F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius))
        part = part.withColumn(axis, spread).groupBy(*grid, "row", "col").agg(f("__v").alias("__v"), F.sum("__n").alias("__n"))
    result = F.col("__v") / F.col("__n") if kind == "mean" else F.col("__v")
    return cells.join(part.select(*grid, "row", "col", result.alias(out)), [*grid, "row", "col"])


def beside(grid: list[str], axis: str, step: int, value: str) -> Column:
    """The value of the cell step away on an axis; null outside or where the cell is missing."""
    other = "row" if axis == "col" else "col"
    w = Window.partitionBy(*grid, other).orderBy(axis)
    f = F.lead if step > 0 else F.lag
    return F.when(F.abs(f(axis).over(w) - F.col(axis)) == abs(step), f(value).over(w))

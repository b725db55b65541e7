"""A bed in closed form, for areas without elevation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def synthetic_bed(grids: DataFrame, cols: int, rows: int) -> DataFrame:
    """Cells of a sloping bed with a channel, a basin and a levee, for each row of grids."""
    c = F.col
    cells = grids.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long")))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    cells = cells.withColumns({"__x": c("col") / (cols - 1), "__y": c("row") / (rows - 1)})
    x, y = c("__x"), c("__y")
    sq = lambda e: e * e
    z = 4.2 - y * 3.4 + sq(x - 0.5) * 1.8 - F.exp(-sq(x - 0.42 - y * 0.18) / 0.012) * 1.6 - F.exp(-(sq(x - 0.62) + sq(y - 0.55)) / 0.02) * 0.9
    levee = F.when((F.abs(x - 0.55) < 0.03) & (y > 0.35) & (y < 0.7), 1.1).otherwise(0.0)
    return cells.withColumn("z", z + levee).drop("__x", "__y")

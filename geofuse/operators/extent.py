"""Planning grids and tiles over what cameras and clouds cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_extent(points: DataFrame, by: str, dem_accuracy: float = 1.0, budget: int = 1024) -> DataFrame:
    """Per site the padded bounds of its points (100 m about zero without any), cells and areas of the grids over them."""
    acc, c = max(dem_accuracy, 0.05), F.col
    b = points.groupBy(by).agg(F.min("e").alias("e0"), F.min("n").alias("n0"), F.max("e").alias("e1"), F.max("n").alias("n1"))
    pad_e, pad_n = F.greatest(c("e1") - c("e0"), F.lit(10.0)) * 0.1, F.greatest(c("n1") - c("n0"), F.lit(10.0)) * 0.1
    b = b.select(
        by, F.coalesce(c("e0") - pad_e, F.lit(-50.0)).alias("min_e"), F.coalesce(c("n0") - pad_n, F.lit(-50.0)).alias("min_n"),
        F.coalesce(c("e1") + pad_e, F.lit(50.0)).alias("max_e"), F.coalesce(c("n1") + pad_n, F.lit(50.0)).alias("max_n"),
    )
    w, h = F.greatest(c("max_e") - c("min_e"), F.lit(1.0)), F.greatest(c("max_n") - c("min_n"), F.lit(1.0))
    b = b.withColumn("diag", F.sqrt(w * w + h * h))
    edge = max(acc, 0.5)
    regional = F.greatest(c("diag") / 200, F.lit(acc * 4))
    return b.withColumns({"preview_cell": F.greatest(c("diag") / max(budget, 64), F.lit(acc)), "fine_area": F.lit(edge * edge * 2), "regional_area": regional * regional})

"""What users call from SQL or hand in: temporary functions, a table function, and their own engine per group."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.functions.flood import H_DRY

# Each is a SQL expression, so calls are inlined into the plan.
SQL_FUNCTIONS = {
    "geo_flat_east(lon DOUBLE, lat DOUBLE, lon0 DOUBLE, lat0 DOUBLE)": ("DOUBLE", "(lon - lon0) * 111320D * cos(radians(lat0))"),
    "geo_flat_north(lat DOUBLE, lat0 DOUBLE)": ("DOUBLE", "(lat - lat0) * 111320D"),
    "geo_tile_x(lon DOUBLE, z INT)": ("BIGINT", "CAST(floor((lon + 180D) / 360D * pow(2D, z)) AS BIGINT)"),
    "flood_is_wet(h DOUBLE)": ("BOOLEAN", f"h > {H_DRY}D"),
    "flood_hazard_cell(h DOUBLE)": ("INT", "CASE WHEN h >= 1.6D THEN 3 WHEN h >= 1D THEN 2 WHEN h >= 0.35D THEN 1 ELSE 0 END"),
    "splat_opacity(logit DOUBLE)": ("DOUBLE", "1D / (1D + exp(-logit))"),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; their names."""
    for head, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("grid_cells", grid_cells_udtf())
    return [h.partition("(")[0] for h in SQL_FUNCTIONS] + ["grid_cells"]


def grid_cells_udtf():
    """The table function grid_cells(west, south, east, north, cols, rows): row, col and centre of each cell; row 0 is south."""

    @F.udtf(returnType="row INT, col INT, lon DOUBLE, lat DOUBLE")
    class GridCells:
        def eval(self, west: float, south: float, east: float, north: float, cols: int, rows: int):
            if None in (west, south, east, north, cols, rows):
                return
            for row in range(rows):
                for col in range(cols):
                    yield row, col, west + (col + 0.5) / cols * (east - west), south + (row + 0.5) / rows * (north - south)

    return GridCells


def upper_median(column: str):
    """The value at place n // 2 of the sorted values, as an aggregate."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def map_engine(df: DataFrame, by: list[str], fn: Callable[[dict, pd.DataFrame], pd.DataFrame], schema: str, most_rows: int = 1_000_000) -> DataFrame:
    """A user's function over each group: fn(key, rows) -> rows of the schema.

    A group larger than most_rows is refused before anything runs: it wouldn't fit a task.
    """
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most_rows:
        raise ValueError(f"a group has {largest} rows, more than {most_rows}")

    def call(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(dict(zip(by, key)), pdf)

    return df.groupBy(*by).applyInPandas(call, schema)

"""Text forms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofuse.functions.geodesy import geodetic_to_ecef


def pose_prior_lines(poses: DataFrame, digits: int = 4) -> DataFrame:
    """name, ECEF position and deviations of each pose, as a line of text."""
    x, y, z = geodetic_to_ecef(F.col("lon_deg"), F.col("lat_deg"), F.col("height_m"))
    line = F.format_string(f"%s %.{digits}f %.{digits}f %.{digits}f %.4f %.4f %.4f", "name", x, y, z, "std_e", "std_n", "std_u")
    return poses.withColumn("line", line)


def geojson_features(df: DataFrame, geometry: str, *properties: str) -> DataFrame:
    """One GeoJSON feature a row, as text: write it with write.text for line-delimited features."""
    parts = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.col(geometry).alias("geometry"))
    return df.withColumn("feature", F.to_json(parts))

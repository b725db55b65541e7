"""The SQL, table-function and engine surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import view
from geofuse.functions import surface as su
from geofuse.queries.registry import query, r

c = F.col


@query("f1_sql_functions", "fx_site", q="SELECT site_id, round((lon - 10e0) * 111320e0 * cos(radians(-41e0)), 4) + 0e0 AS e, CAST(floor((lon + 180e0) / 360e0 * 1024e0) AS BIGINT) AS tile, CASE WHEN lat / 10e0 >= 1.6e0 THEN 3 WHEN lat / 10e0 >= 1e0 THEN 2 WHEN lat / 10e0 >= 0.35e0 THEN 1 ELSE 0 END AS hazard FROM fx_site")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    su.register_sql(spark)
    return view(spark, sf, "fx_site").selectExpr("site_id", "round(geo_flat_east(lon, lat, 10D, -41D), 4) + 0D AS e", "geo_tile_x(lon, 10) AS tile", "flood_hazard_cell(lat / 10D) AS hazard")


@query("f2_grid_cells", "fx_aoi", q="SELECT aoi_id, CAST(i AS INT) AS row, CAST(j AS INT) AS col, round(west + (j + 0.5e0) / 12 * (east - west), 6) + 0e0 AS lon, round(south + (i + 0.5e0) / 8 * (north - south), 6) + 0e0 AS lat FROM fx_aoi, range(0, 8) a(i), range(0, 12) b(j)")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of every area by the table function, laterally joined."""
    su.register_sql(spark)
    a = view(spark, sf, "fx_aoi").select("aoi_id", *[c(k).cast("double").alias(k) for k in ("west", "south", "east", "north")])
    out = spark.sql("SELECT a.aoi_id, g.* FROM {a} a, LATERAL grid_cells(a.west, a.south, a.east, a.north, 12, 8) g", a=a)
    return out.select("aoi_id", "row", "col", r("lon").alias("lon"), r("lat").alias("lat"))


@query("f3_upper_median", "fx_obs", q="SELECT solver, image_id, err_px FROM (SELECT solver, image_id, round(err_px, 6) AS err_px, row_number() OVER (PARTITION BY solver, image_id ORDER BY err_px) - 1 AS i, count(*) OVER (PARTITION BY solver, image_id) AS n FROM fx_obs) x WHERE i = n // 2")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_obs").groupBy("solver", "image_id").agg(r(su.upper_median("err_px")).alias("err_px"))


@query("f4_map_engine", "fx_hydrograph", q="SELECT series_id, round(sum((hours - p) * (stage_m + ps) / 2), 4) + 0e0 AS stage_hours FROM (SELECT series_id, hours, stage_m, lag(hours) OVER w AS p, lag(stage_m) OVER w AS ps FROM fx_hydrograph WINDOW w AS (PARTITION BY series_id ORDER BY hours, sample_id)) x GROUP BY series_id HAVING count(*) > 1")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    """A user's integration over each series."""

    def integral(key: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["hours", "sample_id"])
        area = ((p["hours"] - p["hours"].shift()) * (p["stage_m"] + p["stage_m"].shift()) / 2).sum()
        return pd.DataFrame({"series_id": [key["series_id"]], "stage_hours": [float(area)]} if len(p) > 1 else {"series_id": [], "stage_hours": []})

    h = view(spark, sf, "fx_hydrograph").select("series_id", "sample_id", "hours", "stage_m")
    return su.map_engine(h, ["series_id"], integral, "series_id long, stage_hours double").select("series_id", r("stage_hours", 4).alias("stage_hours"))


CONNECTORS = ("usgs-3dep", "copernicus-glo30", "opentopography", "hydrosheds", "usgs-nwis", "osm-waterways", "fema-nfhl", "earth-search")


@query("s21_list_catalog", "fx_aoi", q="SELECT aoi_id, id, CASE WHEN id = 'usgs-3dep' AND NOT (east > -180 AND west < -64 AND north > 17 AND south < 72) THEN 'coverage may be empty outside the US' WHEN id = 'opentopography' THEN 'needs a key' END AS note FROM fx_aoi, (VALUES " + ", ".join(f"('{k}')" for k in CONNECTORS) + ") k(id)")
def s21(spark: SparkSession, sf: str) -> DataFrame:
    """Every connector for every area, with the notes that apply."""
    from geofuse.functions.geodesy import in_us_envelope

    a = view(spark, sf, "fx_aoi").withColumn("id", F.explode(F.array(*[F.lit(k) for k in CONNECTORS])))
    us = in_us_envelope(c("west"), c("south"), c("east"), c("north"))
    return a.select("aoi_id", "id", F.when((c("id") == "usgs-3dep") & ~us, "coverage may be empty outside the US").when(c("id") == "opentopography", "needs a key").alias("note"))

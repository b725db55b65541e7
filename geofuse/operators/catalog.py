"""Catalog items against areas of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.plans.rangejoin import boxes_that_meet


def clearest_items(aois: DataFrame, items: DataFrame, cloud: float = 40.0, k: int = 10) -> DataFrame:
    """Per area the k items of least cloud that meet it; the cloud limit is pushed to the scan."""
    met = boxes_that_meet(aois, items.filter(F.col("cloud") < cloud), ("west", "south", "east", "north"), ("iw", "is_", "ie", "in_"))
    best = Window.partitionBy("aoi_id").orderBy("cloud", "item_id")
    return met.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= k)


# Formats by extension.
FORMATS = {
    "tif": "geotiff", "tiff": "geotiff", "geotiff": "geotiff", "cog": "cog", "gpkg": "geopackage", "geojson": "geojson", "json": "geojson", "fgb": "flatgeobuf", "parquet": "geoparquet",
    "las": "las", "laz": "laz", "copc": "copc", "zarr": "zarr", "nc": "netcdf", "netcdf": "netcdf", "pmtiles": "pmtiles", "spz": "spz",
}


def geo_format(path):
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("unknown"))


# Licences by source, and the ids that other names of catalog items stand for.
LICENSES = {
    "Apache-2.0": "depth-anything-3 mapanything roma-v2 colmap mvs gs-2d depth-anything-v2",
    "commercial": "vggt-commercial",
    "NVIDIA-OML": "fixer",
    "NC-research": "vggt-omega mast3r dust3r difix vggt-research pi3x stream-vggt vggt-long mast3r-slam slam3r monst3r easi3r city-gaussian urban-gs horizon-gs gof pgsr rade-gs sugar milo",
}
ALIASES = {
    "usgs-3dep": "usgs-3dep usgs3dep 3dep",
    "copernicus-glo30": "copernicus-dem copernicus-glo30 copernicus glo-30 glo30",
    "opentopography": "opentopography opentopo",
    "hydrosheds": "hydrosheds hydrobasins",
    "usgs-nwis-gauges": "usgs-gauges usgs-nwis-gauges nwis gauges noaa-mrms-/-nwm noaa-mrms",
    "fema-nfhl": "fema-nfhl nfhl fema",
    "osm-waterways": "osm-waterways osm waterways overture-/-osm overture",
    "earth-search-stac": "earth-search-stac earth-search stac ecmwf-open-data",
}


def _of(name, groups: dict[str, str]):
    rows = F.create_map(*[F.lit(x) for value, names in groups.items() for key in names.split() for x in (key, value)])
    return F.try_element_at(rows, name)


def license_for(source):
    return F.coalesce(_of(source, LICENSES), F.lit("unknown"))


def resolve_alias(name):
    """The id of a catalog item by any of its names: lower case, blanks as dashes; another name stays itself."""
    key = F.replace(F.lower(name), F.lit(" "), F.lit("-"))
    return F.coalesce(_of(key, ALIASES), key)


def list_cached(files: DataFrame, path: str = "path") -> DataFrame:
    """Of a listing of files those that are cached assets: rasters and features, without the metadata beside them; name and format."""
    name = F.element_at(F.split(path, "/"), -1)
    kept = files.withColumn("name", name).filter(F.lower("name").rlike(r"\.(tif|tiff|cog|geojson|json)$") & ~F.col("name").rlike(r"\.(meta|condition|catalog)\.json$"))
    return kept.withColumn("format", geo_format(F.col("name")))


ENTRY = "id string, title string, provider string, format string, license string, stale boolean, localPath string, notes string"


def list_cached_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog of a folder's own files: id, title, provider, format, license, local_path, notes.

    A .catalog.json file is the entry that it holds, if it can be read. Other rasters and features are local assets, named by their
    file, with an id from the hash of their path; metadata beside them isn't listed, nor are folders below. Only names are read,
    and the catalog files.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("path"))
    local = list_cached(files).select(
        F.concat(F.lit("local-"), F.substring(F.sha2("path", 256), 1, 12)).alias("id"), F.col("name").alias("title"), F.lit("local").alias("provider"), "format",
        F.lit(None).cast("string").alias("license"), F.col("path").alias("local_path"), F.lit("Cached local asset").alias("notes"),
    )
    entries = spark.read.option("pathGlobFilter", "*.catalog.json").text(folder, wholetext=True).select(F.from_json("value", ENTRY).alias("e"))
    entries = entries.filter("e.id IS NOT NULL AND e.title IS NOT NULL AND e.provider IS NOT NULL AND e.format IS NOT NULL")
    return local.unionByName(entries.select("e.id", "e.title", "e.provider", "e.format", "e.license", F.col("e.localPath").alias("local_path"), "e.notes"))


def dem_rank(name):
    lower = F.lower(name)
    return (
        F.when(lower.contains("usgs_3dep"), 0).when(lower.contains("opentopo"), 1)
        .when(lower.contains("copernicus") | lower.contains("glo30") | lower.contains("dsm_cog"), 2).otherwise(3)
    )


def pick_dem_source(files: DataFrame, by: str = "workspace") -> DataFrame:
    """Per workspace the best elevation file by its name; flood products are no sources."""
    best = Window.partitionBy(by).orderBy(dem_rank(F.col("name")), "name")
    kept = files.filter(~F.lower("name").startswith("dtm_flood"))
    return kept.withColumn("__k", F.row_number().over(best)).filter("__k = 1").drop("__k")

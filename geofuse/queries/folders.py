"""Readers of whole folders, on files that are written from the given tables to the shared folder first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import sql, view
from geofuse.operators import catalog as cat
from geofuse.plans.shared import new_dir, stored
from geofuse.queries.registry import query, r
from geofuse.sources import readers as rd
from geofuse.sources.files import save

c = F.col
TEL = "fx_telemetry"
#: Points of a file.
PER_FILE = 100


def _written(contents: DataFrame, spark: SparkSession, label: str) -> str:
    folder = new_dir(spark, label)
    stored(save(contents, folder), f"{label}-files")
    return folder


def _files(rows: DataFrame, kind: Column, name: Column, line: Column, head: Column, tail: Column) -> DataFrame:
    """name and content: the lines of each file between its head and tail; at most PER_FILE rows make one."""
    per = rows.withColumns({"kind": kind, "name": name, "line": line})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "line"))), lambda p: p["line"]), "\n")
    files = per.groupBy("kind", "name").agg(text.alias("text"))
    return files.select("name", F.concat(head, c("text"), tail).cast("binary").alias("content"))


def telemetry_folder(spark: SparkSession, sf: str) -> str:
    """Files of seven kinds: CSV under two headers, marker lines, positions, KML, GPX, and KML without coordinates."""
    t = view(spark, sf, TEL)
    kind = (c("sample_id") % 7).cast("int")
    ends = ("a.csv", "b.CSV", "c.MRK", "d.pos", "e.kml", "f.gpx", "g.kml")
    pick = lambda values: F.get(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), c("kind"))
    lat, lon, h = (F.format_string(f"%.{d}f", k) for k, d in (("lat_deg", 6), ("lon_deg", 6), ("height_m", 3)))
    no = c("sample_id").cast("string")
    lines = [
        F.concat_ws(",", lat, lon, h), F.concat_ws(",", no, h, lon, F.concat(F.lit('"'), lat, F.lit('"')), F.lit("0.5")), F.concat_ws("\t", no, F.lit("1.5"), lat, lon, h),
        F.concat_ws(" ", F.lit("2024/01/02 03:04:05.0"), lat, lon, h), F.concat_ws(",", lon, lat, h),
        F.concat(F.lit('<trkpt lat="'), lat, F.lit('" lon="'), lon, F.lit('"><ele>'), h, F.lit("</ele></trkpt>")), F.lit("<Placemark/>"),
    ]
    name = F.concat(F.lit("part-"), F.floor(c("sample_id") / 7 / PER_FILE), F.lit("-"), F.get(F.array(*[F.lit(e) for e in ends]), kind))
    heads = ("Lat,Longitude,altitude\n", "# a comment\nname,height,LNG,latitude,h_acc\n", "", "% positions\n", "<kml><coordinates>\n", '<gpx><wpt lat="1.5" lon="2.5"/><trk><trkseg>\n', "<kml>\n")
    tails = ("\n", "", "\n", "\n", "\n</coordinates></kml>", "\n</trkseg></trk></gpx>", "\n</kml>")
    return _written(_files(t, kind, name, F.get(F.array(*lines), kind), pick(heads), pick(tails)), spark, "telemetry")


@query("s8_read_sources", TEL, q="""SELECT CASE WHEN k < 2 THEN 'csv' ELSE list_extract(['mrk', 'pos', 'kml', 'gpx'], CAST(k - 1 AS INT)) END AS source, round(lon_deg, 6) + 0e0 AS lon, round(lat_deg, 6) + 0e0 AS lat, round(height_m, 3) + 0e0 AS h,
 list_extract([2e0, 0.5e0, 0.05e0, 0.1e0, 5e0, 3e0], CAST(k + 1 AS INT)) AS std_e FROM (SELECT *, mod(sample_id, 7) AS k FROM fx_telemetry) t WHERE k < 6
 UNION ALL SELECT 'gpx', 2.5e0, 1.5e0, 0e0, 2e0 FROM (SELECT DISTINCT CAST(floor(sample_id / 7e0 / 100) AS BIGINT) FROM fx_telemetry WHERE mod(sample_id, 7) = 5) w""")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of the folder by its own kind and header; a way point in each GPX file besides its track."""
    rows = rd.read_sources(spark, telemetry_folder(spark, sf))
    return rows.select("source", r("lon_deg").alias("lon"), r("lat_deg").alias("lat"), r("height_m", 3).alias("h"), "std_e")


@query("s8_source_warnings", TEL, q="SELECT DISTINCT 'part-' || CAST(floor(sample_id / 7e0 / 100) AS BIGINT) || '-g.kml' AS file, 'no positions' AS warning FROM fx_telemetry WHERE mod(sample_id, 7) = 6")
def s8_warnings(spark: SparkSession, sf: str) -> DataFrame:
    rows = rd.source_warnings(spark, telemetry_folder(spark, sf))
    return rows.select(F.element_at(F.split("file", "/"), -1).alias("file"), "warning")


@query("s5_read_gpx", TEL, q="""SELECT round(lon_deg, 6) + 0e0 AS lon, round(lat_deg, 6) + 0e0 AS lat, round(height_m, 3) + 0e0 AS h, CASE WHEN w THEN 2e0 ELSE 3e0 END AS std_e, CASE WHEN w THEN 5e0 ELSE 8e0 END AS std_u, CASE WHEN NOT w THEN floor(unix_s) END AS unix_s
FROM (SELECT *, mod(sample_id, 4) = 1 AS w FROM fx_telemetry) t""")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with times and way points without, a file for every hundred or so points."""
    t = view(spark, sf, TEL).withColumn("w", c("sample_id") % 4 == 1)
    body = F.format_string(' lat="%.6f" lon="%.6f"><ele>%.3f</ele><time>%s</time>', "lat_deg", "lon_deg", "height_m", F.date_format(F.timestamp_seconds(F.floor("unix_s")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.when(c("w"), F.concat(F.lit("<wpt"), body, F.lit("</wpt>"))).otherwise(F.concat(F.lit("<trk><trkseg><trkpt"), body, F.lit("</trkpt></trkseg></trk>")))
    name = F.concat(F.lit("track-"), F.floor(c("sample_id") / PER_FILE), F.lit(".gpx"))
    folder = _written(_files(t, F.lit(0), name, line, F.lit("<gpx>\n"), F.lit("\n</gpx>")), spark, "gpx")
    g = rd.read_gpx(spark, folder)
    return g.select(r("lon_deg").alias("lon"), r("lat_deg").alias("lat"), r("height_m", 3).alias("h"), "std_e", "std_u", "unix_s")


@query("s21_list_cached_folder", q="""SELECT CASE WHEN k = 3 THEN 'item-' || nm END AS entry, CASE WHEN k = 3 THEN n || ' parts' ELSE 'a-' || nm || list_extract(['.TIF', '.json', '.cog'], CAST(k + 1 AS INT)) END AS title,
 CASE WHEN k = 3 THEN p_brand ELSE 'local' END AS provider, list_extract(['geotiff', 'geojson', 'cog', 'laz'], CAST(k + 1 AS INT)) AS format
FROM (SELECT p_brand, replace(p_brand, '#', '') || '-' || p_size AS nm, count(*) AS n, mod(p_size, 7) AS k FROM part GROUP BY p_brand, p_size) p WHERE k < 4""")
def s21_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of assets, of the metadata beside them and of catalog files, some of which can't be read; a file for each brand and size."""
    p = sql(spark, sf, "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size")
    ends = F.array(*[F.lit(e) for e in (".TIF", ".json", ".cog", ".catalog.json", ".meta.json", ".las", "-bad.catalog.json")])
    name, kind = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("-"), c("p_size")), (c("p_size") % 7).cast("int")
    entry = F.to_json(F.struct(F.concat(F.lit("item-"), name).alias("id"), F.concat(c("n"), F.lit(" parts")).alias("title"), c("p_brand").alias("provider"), F.lit("laz").alias("format"), F.lit(False).alias("stale")))
    files = p.select(F.concat(F.lit("a-"), name, F.get(ends, kind)).alias("name"), F.when(kind == 3, entry).otherwise(F.lit("{")).cast("binary").alias("content"))
    out = cat.list_cached_folder(spark, _written(files, spark, "cached"))
    return out.select(F.when(~c("id").startswith("local-"), c("id")).alias("entry"), "title", "provider", "format")

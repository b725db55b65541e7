"""Readers, text and catalogs, on texts made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.fixtures import sql, view
from geofuse.functions import text as tx
from geofuse.operators import catalog as cat
from geofuse.queries.registry import query, r
from geofuse.sources import readers as rd
from geofuse.sources.sinks import geojson_features as to_features

c = F.col
TEL = "fx_telemetry"


@query("s1_telemetry_csv", TEL, q="SELECT sample_id, round(lon_deg, 6) AS lon, round(lat_deg, 6) AS lat, floor(unix_s) AS unix_s, greatest(abs(std_e), 0.05e0) AS std_e, CASE WHEN mod(sample_id, 3) = 0 THEN 2 * greatest(abs(std_e), 0.05e0) ELSE std_u END AS std_u FROM fx_telemetry WHERE mod(sample_id, 10) <> 7")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """Strings under other headers and gaps, as a file would have them."""
    t = view(spark, sf, TEL)
    rows = t.select(
        c("sample_id").cast("string").alias("ID"), c("lat_deg").cast("string").alias("Latitude"), F.when(c("sample_id") % 10 == 7, "n/a").otherwise(c("lon_deg").cast("string")).alias("LNG"),
        F.when(c("sample_id") % 2 == 0, (F.floor("unix_s") * 1000).cast("string")).otherwise(F.date_format(F.timestamp_seconds(F.floor("unix_s")), "yyyy:MM:dd HH:mm:ss")).alias("time"),
        c("std_e").cast("string").alias("h_acc"), F.when(c("sample_id") % 3 != 0, c("std_u").cast("string")).alias("v_acc"),
    )
    keyed = rd.telemetry_csv(rows.withColumnRenamed("ID", "yaw"))  # the key travels in a numeric column
    return keyed.select(c("heading_deg").cast("long").alias("sample_id"), r("lon_deg").alias("lon"), r("lat_deg").alias("lat"), F.round("unix_s", 0).alias("unix_s"), "std_e", "std_u")


@query("s2_srt", TEL, q="SELECT sample_id, round(lat_deg, 6) AS lat, round(lon_deg, 6) AS lon, round(height_m, 3) AS h, CASE WHEN mod(sample_id, 2) = 0 THEN 0.05e0 ELSE 2e0 END AS std_e FROM fx_telemetry")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    """A subtitle file a track: its cues are split and read."""
    t = view(spark, sf, TEL)
    cue = F.format_string("%d\n00:00:00,000 --> 00:00:01,000\n[latitude: %.6f] [longitude: %.6f] [rel_alt: 1.0 abs_alt: %.3f] [yaw: %d]%s", "sample_id", "lat_deg", "lon_deg", "height_m", "sample_id", F.when(c("sample_id") % 2 == 0, " RTK").otherwise(""))
    files = t.withColumn("cue", cue).groupBy("track_id", F.floor(c("sample_id") / 50).alias("part")).agg(F.array_join(F.collect_list("cue"), "\n\n").alias("value"))
    s = rd.srt_cues(files)
    return s.select(c("heading_deg").cast("long").alias("sample_id"), r("lat_deg").alias("lat"), r("lon_deg").alias("lon"), r("height_m", 3).alias("h"), "std_e")


@query("s7_gcp_csv", "fx_gcp", q="SELECT CAST(gcp_id AS VARCHAR) AS gcp_id, round(qx, 6) + 0e0 AS px, round(qy, 6) + 0e0 AS py, 'local-ENU-m' AS crs FROM fx_gcp")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    g = view(spark, sf, "fx_gcp").select(c("gcp_id").cast("string").alias("Name"), c("qx").cast("string").alias("Easting"), c("qy").cast("string").alias("Northing"), c("qz").cast("string").alias("h"))
    return rd.gcp_csv(g).select("gcp_id", r("px").alias("px"), r("py").alias("py"), "crs")


@query("s9_nwis_rdb", "fx_site", q="SELECT CAST(site_id AS VARCHAR) AS site_no, round(lat, 4) + 0e0 AS lat, round(lon, 4) + 0e0 AS lon FROM fx_site WHERE mod(site_id, 9) <> 4")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws("\t", F.lit("USGS"), c("site_id"), F.lit("a site"), F.lit("ST"), F.when(c("site_id") % 9 == 4, "").otherwise(F.format_string("%.4f", "lat")), F.format_string("%.4f", "lon"))
    lines = view(spark, sf, "fx_site").select(F.explode(F.array(line, F.lit("# a comment"), F.lit("5s\t15s\t50s\t2s\t16s\t16s"), F.lit("agency_cd\tsite_no\tname\ttype\tdec_lat_va\tdec_long_va"))).alias("value"))
    return rd.nwis_rdb(lines).select("site_no", r("lat", 4).alias("lat"), r("lon", 4).alias("lon"))


@query("s10_nwis_iv", "fx_gauge_obs", q="SELECT CAST(site_no AS VARCHAR) AS site_no, parameter_cd, count(*) AS n, round(sum(value), 3) AS total FROM fx_gauge_obs GROUP BY ALL")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of nested series, one a site and parameter and day, back to readings."""
    g = view(spark, sf, "fx_gauge_obs")
    reading = F.struct(c("value").cast("string").alias("value"), c("ts").cast("string").alias("dateTime"))
    v = g.groupBy("site_no", "parameter_cd", F.to_date("ts").alias("day")).agg(F.collect_list(reading).alias("value"))
    series = F.struct(
        F.struct(F.lit("s").alias("siteName"), F.array(F.struct(c("site_no").cast("string").alias("value"))).alias("siteCode"), F.struct(F.struct(F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude")).alias("geogLocation")).alias("geoLocation")).alias("sourceInfo"),
        F.struct(F.array(F.struct(c("parameter_cd").alias("value"))).alias("variableCode")).alias("variable"), F.array(F.struct("value")).alias("values"),
    )
    docs = v.select(F.to_json(F.struct(F.struct(F.array(series).alias("timeSeries")).alias("value"))).alias("value"))
    return rd.nwis_iv(docs).groupBy("site_no", "parameter_cd").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 3).alias("total"))


@query("s11_osm_waterways", q="SELECT o_orderkey AS osm_id, CASE WHEN mod(o_orderkey, 3) = 0 THEN 'waterway' ELSE 'Creek' END AS name, 'stream' AS class, CAST(mod(o_orderkey, 6) AS INT) AS vertices FROM orders WHERE mod(o_orderkey, 6) >= 2")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    o = sql(spark, sf, "SELECT o_orderkey AS k FROM orders")
    tags = F.when(c("k") % 3 == 0, F.create_map(F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.lit("name"), F.lit("Creek")))
    points = F.transform(F.slice(F.sequence(F.lit(1), F.lit(6)), F.lit(1), (c("k") % 6).cast("int")), lambda i: F.struct((i * 1.0).alias("lat"), (i * 2.0).alias("lon")))
    docs = o.select(F.to_json(F.struct(F.array(F.struct(c("k").alias("id"), tags.alias("tags"), points.alias("geometry"))).alias("elements"))).alias("value"))
    return rd.osm_waterways(docs).select("osm_id", "name", "class", "vertices")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Areas as polygons in feature collections."""
    ring = F.array(*[F.array(c(x), c(y)) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    a = view(spark, sf, "fx_aoi").withColumns({k: c(k).cast("double") for k in ("west", "south", "east", "north")}).withColumn("geometry", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    f = to_features(a, "geometry", "aoi_id")
    return f.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), c("feature"), F.lit("]}")).alias("value"))


@query("s12_geojson", "fx_aoi", q="SELECT CAST(aoi_id AS BIGINT) AS aoi_id, 'Polygon' AS kind FROM fx_aoi")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    return rd.geojson_features(_features(spark, sf)).select(F.get_json_object("properties", "$.aoi_id").cast("long").alias("aoi_id"), "kind")


@query("a22_geojson_bbox", "fx_aoi", q="SELECT CAST(aoi_id AS BIGINT) AS aoi_id, west * 1e0 AS west, south * 1e0 AS south, east * 1e0 AS east, north * 1e0 AS north FROM fx_aoi")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    f = rd.geojson_features(_features(spark, sf)).withColumn("aoi_id", F.get_json_object("properties", "$.aoi_id").cast("long"))
    return rd.geometry_bounds(f, ["aoi_id"])


@query("s13_write_geojson", "fx_site", q="""SELECT site_id, '{"type":"Feature","properties":{"site_id":' || site_id || '}}' AS feature FROM fx_site""")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "fx_site").withColumn("geometry", F.lit(None).cast("string"))
    return to_features(s, "geometry", "site_id").select("site_id", "feature")


@query("s15_grid_json", "fx_depth_ts", q="SELECT run_id, t_s, CAST(row AS INT) AS row, CAST(row_number() OVER (PARTITION BY run_id, t_s, row ORDER BY col) - 1 AS INT) AS col, round(h, 6) AS z FROM fx_depth_ts")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of cells as grids of one row in JSON, and back to cells."""
    t = view(spark, sf, "fx_depth_ts").groupBy("run_id", "t_s", "row").agg(F.array_sort(F.collect_list(F.struct("col", "h"))).alias("cells"))
    docs = t.withColumn("value", F.to_json(F.struct(F.size("cells").alias("cols"), F.lit(1).alias("rows"), c("cells.h").alias("z"))))
    g = rd.grid_json(docs.withColumnRenamed("row", "grow"), ["run_id", "t_s", "grow"])
    return g.select("run_id", "t_s", c("grow").cast("int").alias("row"), "col", r("z").alias("z"))


@query("s20_time_series", "fx_hydrograph", q="SELECT series_id, count(*) AS n, round(min(hours), 6) AS first_h, round(max(stage_m), 6) AS peak FROM fx_hydrograph GROUP BY series_id")
def s20(spark: SparkSession, sf: str) -> DataFrame:
    """Samples into one JSON document a series and part, and exploded again."""
    h = view(spark, sf, "fx_hydrograph").groupBy("series_id", F.floor(c("sample_id") / 100).alias("part")).agg(F.collect_list(F.struct("hours", c("stage_m").alias("stageM"))).alias("samples"))
    docs = h.select("series_id", F.to_json(F.struct("samples")).alias("value"))
    s = docs.select("series_id", F.explode(F.from_json("value", "samples array<struct<hours: double, stageM: double>>")["samples"]).alias("s"))
    return s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), r(F.min("s.hours")).alias("first_h"), r(F.max("s.stageM")).alias("peak"))


FILES = "(SELECT mod(p_partkey, 20) AS workspace, CASE mod(p_partkey, 7) WHEN 0 THEN 'USGS_3DEP_' WHEN 1 THEN 'opentopo_' WHEN 2 THEN 'copernicus_' WHEN 3 THEN 'dtm_flood_' WHEN 4 THEN 'x_GLO30_' ELSE 'other_' END || p_partkey || CASE mod(p_partkey, 3) WHEN 0 THEN '.TIF' WHEN 1 THEN '.laz' ELSE '.bin' END AS name FROM part)"


@query("s22_pick_dem_source", q=f"""SELECT workspace, name FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY CASE WHEN lower(name) LIKE '%usgs_3dep%' THEN 0 WHEN lower(name) LIKE '%opentopo%' THEN 1 WHEN lower(name) LIKE '%copernicus%' OR lower(name) LIKE '%glo30%' OR lower(name) LIKE '%dsm_cog%' THEN 2 ELSE 3 END, name) AS k FROM {FILES} f WHERE NOT starts_with(lower(name), 'dtm_flood')) x WHERE k = 1""")
def s22(spark: SparkSession, sf: str) -> DataFrame:
    return cat.pick_dem_source(sql(spark, sf, f"SELECT * FROM {FILES}")).select("workspace", "name")


@query("p12_geo_format", q=f"SELECT name, CASE lower(regexp_extract(name, '\\.([^.]+)$', 1)) WHEN 'tif' THEN 'geotiff' WHEN 'laz' THEN 'laz' ELSE 'unknown' END AS format FROM {FILES} f")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return sql(spark, sf, f"SELECT * FROM {FILES}").select("name", cat.geo_format(c("name")).alias("format"))


@query("p11_parse_time", q="SELECT event_id, floor(epoch_us(ts) / 1e6) AS unix_s, floor(epoch_us(ts) / 1e6) AS from_name FROM events")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    """Times written in four ways, and in file names."""
    e = sql(spark, sf, "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events")
    s = F.floor(F.unix_micros("ts") / 1e6)
    at = F.timestamp_seconds(s)
    k = c("event_id") % 4
    written = F.when(k == 0, s.cast("string")).when(k == 1, (s * 1000).cast("string")).when(k == 2, F.date_format(at, "yyyy:MM:dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    name = F.concat(F.lit("DJI_"), F.date_format(at, "yyyyMMdd"), F.lit("_"), F.date_format(at, "HHmmss"), F.lit("_0001"))
    t = e.select("event_id", written.alias("w"), name.alias("name"))
    return t.select("event_id", F.floor(tx.parse_loose_time(c("w")) + 1e-3).cast("double").alias("unix_s"), F.floor(tx.time_from_name(c("name")) + 1e-3).cast("double").alias("from_name"))


@query("p33_json_path", q="SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 12e0) AS k, 12e0 AS missing FROM events")
def p33(spark: SparkSession, sf: str) -> DataFrame:
    return sql(spark, sf, "SELECT event_id, props FROM events").select("event_id", tx.json_or(c("props"), "$.k", 12.0).alias("k"), tx.json_or(c("props"), "$.durationHours", 12.0).alias("missing"))


@query("p34_text_number", q="SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity, 2) AS height FROM lineitem")
def p34(spark: SparkSession, sf: str) -> DataFrame:
    t = sql(spark, sf, "SELECT l_orderkey, l_linenumber, l_partkey, concat('id 7; ALT = ', CAST(l_quantity AS STRING), ' m, yaw: 3') AS t FROM lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.round(tx.number_after(c("t"), ("abs_alt", "alt")), 2).alias("height"))


@query("p31_promotion_failing", q="SELECT o_orderkey AS k, array_to_string(list_filter(['mass', 'extent', 'licence'], lambda g: CASE g WHEN 'mass' THEN mod(o_orderkey, 2) = 0 WHEN 'extent' THEN mod(o_orderkey, 3) = 0 ELSE mod(o_orderkey, 5) = 0 END), ',') AS failing FROM orders")
def p31(spark: SparkSession, sf: str) -> DataFrame:
    o = sql(spark, sf, "SELECT o_orderkey AS k FROM orders")
    gates = F.array(*[F.struct(F.lit(n).alias("name"), (c("k") % m != 0).alias("ok")) for n, m in (("mass", 2), ("extent", 3), ("licence", 5))])
    return o.select("k", F.array_join(F.transform(F.filter(gates, lambda g: ~g["ok"]), lambda g: g["name"]), ",").alias("failing"))


@query("a27_manifest_hash", "fx_checkpoint", q="SELECT run_no, sha256(string_agg(ckpt_id || ':' || printf('%.2f', mass_m3), '|' ORDER BY ckpt_id)) AS manifest FROM fx_checkpoint GROUP BY run_no")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of a run's ordered artifacts; numbers in two decimals, so that the text is agreed."""
    part = F.struct("ckpt_id", F.concat(c("ckpt_id"), F.lit(":"), F.format_string("%.2f", "mass_m3")).alias("t"))
    g = view(spark, sf, "fx_checkpoint").groupBy("run_no").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return g.select("run_no", F.sha2(F.array_join(c("parts.t"), "|"), 256).alias("manifest"))


@query("a21_extent_plan", q="""WITH b AS (SELECT c_nationkey AS site, min(mod(c_custkey * 37, 900)) * 1e0 AS e0, max(mod(c_custkey * 37, 900)) * 1e0 AS e1, min(mod(c_custkey * 53, 700)) * 1e0 AS n0, max(mod(c_custkey * 53, 700)) * 1e0 AS n1 FROM customer GROUP BY 1),
p AS (SELECT site, e0 - greatest(e1 - e0, 10e0) * 0.1e0 AS e0, e1 + greatest(e1 - e0, 10e0) * 0.1e0 AS e1, n0 - greatest(n1 - n0, 10e0) * 0.1e0 AS n0, n1 + greatest(n1 - n0, 10e0) * 0.1e0 AS n1 FROM b),
d AS (SELECT *, sqrt(greatest(e1 - e0, 1e0) * greatest(e1 - e0, 1e0) + greatest(n1 - n0, 1e0) * greatest(n1 - n0, 1e0)) AS diag FROM p)
SELECT site, round(e0, 6) + 0e0 AS min_e, round(n1, 6) + 0e0 AS max_n, round(diag, 6) AS diag, round(greatest(diag / 1024, 2e0), 6) AS preview_cell, round(2 * 2e0 * 2e0, 6) AS fine_area, round(greatest(diag / 200, 8e0) * greatest(diag / 200, 8e0), 4) AS regional_area FROM d""")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    from geofuse.operators.extent import plan_extent

    cams = sql(spark, sf, "SELECT c_nationkey AS site, mod(c_custkey * 37, 900) * 1e0 AS e, mod(c_custkey * 53, 700) * 1e0 AS n FROM customer")
    p = plan_extent(cams, "site", dem_accuracy=2.0)
    return p.select("site", r("min_e").alias("min_e"), r("max_n").alias("max_n"), r("diag").alias("diag"), r("preview_cell").alias("preview_cell"), r("fine_area").alias("fine_area"), r("regional_area", 4).alias("regional_area"))


@query("o2_latest_done_run", q="""SELECT k, run FROM (SELECT o_custkey AS k, o_orderkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, o_orderkey DESC) AS q FROM orders) x WHERE q = 1""")
def o2(spark: SparkSession, sf: str) -> DataFrame:
    """The last finished run of a project, else its last."""
    o = sql(spark, sf, "SELECT o_custkey AS k, o_orderkey AS run, o_orderstatus AS status FROM orders")
    return o.groupBy("k").agg(F.max_by("run", F.struct((c("status") == "F").cast("int"), "run")).alias("run"))


@query("o3_newest", "fx_checkpoint", q="SELECT run_no, ckpt_id FROM (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY time_s DESC, ckpt_id DESC) AS k FROM fx_checkpoint) x WHERE k = 1")
def o3(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("run_no").orderBy(c("time_s").desc(), c("ckpt_id").desc())
    return view(spark, sf, "fx_checkpoint").withColumn("k", F.row_number().over(w)).filter("k = 1").select("run_no", "ckpt_id")


@query("u1_union_sources", TEL, "fx_frame", q="SELECT source, count(*) AS n FROM (SELECT source FROM fx_telemetry UNION ALL SELECT 'frame' FROM fx_frame) x GROUP BY source")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    u = view(spark, sf, TEL).unionByName(view(spark, sf, "fx_frame").withColumn("source", F.lit("frame")), allowMissingColumns=True)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("u2_distinct_pairs", q="SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    return sql(spark, sf, "SELECT l_partkey, l_suppkey FROM lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()

"""Geodesy, telemetry and areas of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import sql, view
from geofuse.functions import geodesy as g
from geofuse.operators import telemetry as tm
from geofuse.plans.asof import asof_nearest, interpolated
from geofuse.plans.rangejoin import points_in_boxes
from geofuse.queries.registry import query, r

c = F.col
# The ellipsoid, as SQL text.
E2 = "(0.0033528106647474805e0 * (2e0 - 0.0033528106647474805e0))"
N = f"(6378137e0 / sqrt(1e0 - {E2} * sin(radians(lat_deg)) * sin(radians(lat_deg))))"
X = f"({N} + height_m) * cos(radians(lat_deg)) * cos(radians(lon_deg))"
Y = f"({N} + height_m) * cos(radians(lat_deg)) * sin(radians(lon_deg))"
Z = f"({N} * (1e0 - {E2}) + height_m) * sin(radians(lat_deg))"
ORIGIN = """origin AS (SELECT track_id, sum(w * lon_deg) / sum(w) AS lon0, sum(w * lat_deg) / sum(w) AS lat0, sum(w * height_m) / sum(w) AS h0,
  avg(greatest(std_e, std_n)) AS uncertainty_m, count(*) AS fixes FROM (SELECT *, 1e0 / (greatest(0.05e0, std_e, std_n) * greatest(0.05e0, std_e, std_n)) AS w FROM fx_telemetry) t GROUP BY track_id)"""
# Nearest fix, by plain comparison of every frame with the fixes of its track.
MATCH = """near AS (SELECT * FROM (SELECT f.track_id, f.frame_id, f.unix_s, t.* EXCLUDE (track_id, unix_s), abs(f.unix_s - t.unix_s) AS dt,
  row_number() OVER (PARTITION BY f.frame_id ORDER BY abs(f.unix_s - t.unix_s), t.unix_s, t.sample_id) AS k
  FROM fx_frame f JOIN fx_telemetry t ON f.track_id = t.track_id) m WHERE k = 1 AND dt <= {tol})"""


def _geodetic(df: DataFrame) -> tuple:
    return c("lon_deg"), c("lat_deg"), c("height_m")


@query("p1_geodetic_to_ecef", "fx_telemetry", q=f"SELECT sample_id, round({X}, 3) + 0e0 AS x, round({Y}, 3) + 0e0 AS y, round({Z}, 3) + 0e0 AS z FROM fx_telemetry")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = g.geodetic_to_ecef(c("lon_deg"), c("lat_deg"), c("height_m"))
    return view(spark, sf, "fx_telemetry").select("sample_id", r(x, 3).alias("x"), r(y, 3).alias("y"), r(z, 3).alias("z"))


@query(
    "p2_ecef_to_geodetic", "fx_telemetry",
    q="SELECT sample_id, round(lon_deg, 6) + 0e0 AS lon, round(lat_deg, 6) + 0e0 AS lat, round(height_m, 3) + 0e0 AS h FROM fx_telemetry",
)
def p2(spark: SparkSession, sf: str) -> DataFrame:
    """There and back again must give the input, to 0.1 m and better."""
    x, y, z = g.geodetic_to_ecef(c("lon_deg"), c("lat_deg"), c("height_m"))
    df = view(spark, sf, "fx_telemetry").withColumns({"x": x, "y": y, "z": z})
    lon, lat, h = g.ecef_to_geodetic(c("x"), c("y"), c("z"))
    return df.select("sample_id", r(lon).alias("lon"), r(lat).alias("lat"), r(h, 3).alias("h"))


@query("a1_track_origin", "fx_telemetry", q=f"WITH {ORIGIN} SELECT track_id, round(lon0, 8) AS lon0, round(lat0, 8) AS lat0, round(h0, 6) AS h0, round(uncertainty_m, 6) AS uncertainty_m, fixes FROM origin")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    o = tm.track_origin(view(spark, sf, "fx_telemetry"))
    return o.select("track_id", r("lon0", 8).alias("lon0"), r("lat0", 8).alias("lat0"), r("h0").alias("h0"), r("uncertainty_m").alias("uncertainty_m"), "fixes")


@query("j1_asof_nearest", "fx_telemetry", "fx_frame", q=f"WITH {MATCH.format(tol='3600e0')} SELECT track_id, frame_id, sample_id, round(dt, 6) AS dt, source FROM near")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    m = tm.match_frames(view(spark, sf, "fx_frame"), view(spark, sf, "fx_telemetry"), 3600.0)
    return m.select("track_id", "frame_id", "sample_id", r("dt").alias("dt"), "source")


ENU = f"""posed AS (SELECT n.*, lon0, lat0, h0, {X} AS x, {Y} AS y, {Z} AS z FROM near n JOIN origin USING (track_id)),
o AS (SELECT p.*, {X.replace('lat_deg', 'lat0').replace('lon_deg', 'lon0').replace('height_m', 'h0')} AS x0, {Y.replace('lat_deg', 'lat0').replace('lon_deg', 'lon0').replace('height_m', 'h0')} AS y0,
  {Z.replace('lat_deg', 'lat0').replace('lon_deg', 'lon0').replace('height_m', 'h0')} AS z0 FROM posed p)"""


@query(
    "j1_georeference", "fx_telemetry", "fx_frame",
    q=f"""WITH {ORIGIN}, {MATCH.format(tol='3600e0')}, {ENU}
SELECT track_id, frame_id, sample_id, round(x, 3) + 0e0 AS ecef_x, round(y, 3) + 0e0 AS ecef_y, round(z, 3) + 0e0 AS ecef_z,
  round(-sin(radians(lon0)) * (x - x0) + cos(radians(lon0)) * (y - y0), 3) + 0e0 AS enu_e,
  round(-sin(radians(lat0)) * cos(radians(lon0)) * (x - x0) - sin(radians(lat0)) * sin(radians(lon0)) * (y - y0) + cos(radians(lat0)) * (z - z0), 3) + 0e0 AS enu_n,
  round(cos(radians(lat0)) * cos(radians(lon0)) * (x - x0) + cos(radians(lat0)) * sin(radians(lon0)) * (y - y0) + sin(radians(lat0)) * (z - z0), 3) + 0e0 AS enu_u FROM o""",
)
def j1_georeference(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: origin per track, nearest fix per frame, ECEF and ENU poses."""
    p = tm.georeference(view(spark, sf, "fx_frame"), view(spark, sf, "fx_telemetry"), 3600.0)
    return p.select("track_id", "frame_id", "sample_id", *[r(k, 3).alias(k) for k in ("ecef_x", "ecef_y", "ecef_z", "enu_e", "enu_n", "enu_u")])


@query("p3_enu_round_trip", "fx_telemetry", q="SELECT sample_id, round(lon_deg, 6) + 0e0 AS lon, round(lat_deg, 6) + 0e0 AS lat, round(height_m, 3) + 0e0 AS h FROM fx_telemetry")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "fx_telemetry")
    t = t.join(tm.track_origin(t), "track_id")
    o = (c("lon0"), c("lat0"), c("h0"))
    x, y, z = g.geodetic_to_ecef(*_geodetic(t))
    t = t.withColumns({"x": x, "y": y, "z": z})
    e, n, u = g.ecef_to_enu(c("x"), c("y"), c("z"), *o)
    t = t.withColumns({"e": e, "n": n, "u": u})
    x, y, z = g.enu_to_ecef(c("e"), c("n"), c("u"), *o)
    t = t.withColumns({"x": x, "y": y, "z": z})
    lon, lat, h = g.ecef_to_geodetic(c("x"), c("y"), c("z"))
    return t.select("sample_id", r(lon).alias("lon"), r(lat).alias("lat"), r(h, 3).alias("h"))


@query("j14_fallback_poses", "fx_telemetry", "fx_frame", q=f"""WITH {MATCH.format(tol='0.5e0')}
SELECT track_id, sample_id, printf('telemetry_%05d', row_number() OVER (PARTITION BY track_id ORDER BY unix_s, sample_id) - 1) AS name
FROM fx_telemetry WHERE track_id NOT IN (SELECT track_id FROM near)""")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "fx_telemetry")
    return tm.fallback_poses(tm.match_frames(view(spark, sf, "fx_frame"), t), t).select("track_id", "sample_id", "name")


@query("s19_pose_priors", "fx_telemetry", "fx_frame", q=f"""WITH {MATCH.format(tol='3600e0')}
SELECT frame_id, printf('frame_%d %.2f %.2f %.2f %.4f %.4f %.4f', frame_id, {X}, {Y}, {Z}, std_e, std_n, std_u) AS line FROM near""")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    """Text lines of pose priors (two decimals here, so that both engines print alike)."""
    from geofuse.sources.sinks import pose_prior_lines

    m = tm.match_frames(view(spark, sf, "fx_frame"), view(spark, sf, "fx_telemetry"), 3600.0)
    return pose_prior_lines(m.withColumn("name", F.format_string("frame_%d", "frame_id")), 2).select("frame_id", "line")


@query("a2_sim3_sums", "fx_gcp", q="""WITH m AS (SELECT group_id, avg(lx) AS ml, avg(qx) AS mq, avg(ly) AS nl, avg(qy) AS nq, avg(lz) AS ol, avg(qz) AS oq FROM fx_gcp GROUP BY group_id)
SELECT group_id, count(*) AS n, round(sqrt(avg((lx - ml) ** 2 + (ly - nl) ** 2 + (lz - ol) ** 2)), 6) AS radius_l, round(sqrt(avg((qx - mq) ** 2 + (qy - nq) ** 2 + (qz - oq) ** 2)), 6) AS radius_q,
 round(sum((lx - ml) * (qx - mq)), 4) + 0e0 AS h_lx_qx, round(sum((ly - nl) * (qx - mq)), 4) + 0e0 AS h_ly_qx, round(sum((lz - ol) * (qz - oq)), 4) + 0e0 AS h_lz_qz
FROM fx_gcp JOIN m USING (group_id) GROUP BY group_id""")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    s = tm.sim3_sums(view(spark, sf, "fx_gcp"), ["group_id"])
    return s.select("group_id", "n", r("radius_l").alias("radius_l"), r("radius_q").alias("radius_q"), *[r(k, 4).alias(k) for k in ("h_lx_qx", "h_ly_qx", "h_lz_qz")])


@query("a2_fit_sim3")
def a2_fit(spark: SparkSession, sf: str) -> DataFrame:
    return tm.fit_sim3(view(spark, sf, "fx_gcp"), ["group_id"])


@query("a3_gcp_residuals")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    gcp = view(spark, sf, "fx_gcp")
    return tm.gcp_residuals(gcp, tm.fit_sim3(gcp, ["group_id"]), ["group_id"])[0]


AOI = "(SELECT aoi_id, west AS w, south AS s, CASE WHEN mod(aoi_id, 5) = 4 THEN west - 2e0 ELSE east END AS e, CASE WHEN mod(aoi_id, 7) = 3 THEN south + 3e0 ELSE north END AS n FROM fx_aoi)"


def _aoi(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "fx_aoi")
    return a.select("aoi_id", c("west").cast("double").alias("w"), c("south").cast("double").alias("s"),
                    F.when(c("aoi_id") % 5 == 4, c("west") - 2.0).otherwise(c("east")).cast("double").alias("e"),
                    F.when(c("aoi_id") % 7 == 3, c("south") + 3.0).otherwise(c("north")).cast("double").alias("n"))


BOX = ("w", "s", "e", "n")


@query("p5_aoi_rules", "fx_aoi", q=f"""SELECT aoi_id, least(w, e) AS west, least(s, n) AS south, greatest(w, e) AS east, greatest(s, n) AS north, e - w > 1e-5 AND n - s > 1e-5 AS valid,
 CASE WHEN e <= w OR n <= s THEN 'not positive' WHEN w < -180 OR e > 180 OR s < -90 OR n > 90 THEN 'outside WGS84' WHEN e - w > 5 OR n - s > 5 THEN 'too large' END AS reason FROM {AOI} a""")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    west, south, east, north = g.normalized(*map(c, BOX))
    return _aoi(spark, sf).select("aoi_id", west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"), g.aoi_valid(*map(c, BOX)).alias("valid"), g.aoi_reject_reason(*map(c, BOX)).alias("reason"))


GRID = """SELECT aoi_id, round(dx, 6) AS dx, CAST(greatest(24, least(192, floor(wm / dx + 0.5e0))) AS INT) AS cols, CAST(greatest(16, least(144, floor(hm / dx + 0.5e0))) AS INT) AS rows
FROM (SELECT *, greatest(4e0, greatest(wm, hm, 50e0) / 96e0) AS dx FROM (SELECT aoi_id, (east - west) * 111320e0 * cos(radians((south + north) * 0.5e0)) AS wm, (north - south) * 111320e0 AS hm FROM fx_aoi) a) b"""


@query("p6_grid_domain", "fx_aoi", q=GRID)
def p6(spark: SparkSession, sf: str) -> DataFrame:
    dx, cols, rows = g.grid_domain(c("west"), c("south"), c("east"), c("north"))
    return view(spark, sf, "fx_aoi").select("aoi_id", r(dx).alias("dx"), cols.alias("cols"), rows.alias("rows"))


@query("p7_dem_pixel_size", "fx_aoi", q="""WITH a AS (SELECT aoi_id, (east - west) * 111320e0 * greatest(abs(cos(radians((south + north) * 0.5e0))), 0.2e0) AS wm, (north - south) * 111320e0 AS hm FROM fx_aoi),
b AS (SELECT *, greatest(ceil(wm / 30e0), 1) AS w, greatest(ceil(hm / 30e0), 1) AS h FROM a),
d AS (SELECT *, CASE WHEN greatest(w, h) > 2048 THEN greatest(floor(w * (2048e0 / greatest(w, h))), 1) ELSE w END AS w2, CASE WHEN greatest(w, h) > 2048 THEN greatest(floor(h * (2048e0 / greatest(w, h))), 1) ELSE h END AS h2 FROM b)
SELECT aoi_id, CAST(w2 AS INT) AS w, CAST(h2 AS INT) AS h, round((wm / w2 + hm / h2) * 0.5e0, 6) AS cell FROM d""")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    w, h, cell = g.dem_pixel_size(c("west"), c("south"), c("east"), c("north"))
    return view(spark, sf, "fx_aoi").select("aoi_id", w.alias("w"), h.alias("h"), r(cell).alias("cell"))


@query("p8_tiles", "fx_site", q="""SELECT site_id, CAST(floor((lon + 180e0) / 360e0 * 4096e0) AS BIGINT) AS x, CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 4096e0) AS BIGINT) AS y FROM fx_site""")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    x, y = g.lonlat_to_tile(c("lon"), c("lat"), 12)
    return view(spark, sf, "fx_site").select("site_id", x.alias("x"), y.alias("y"))


@query("p8_pick_zoom", "fx_aoi", q="""WITH z AS (SELECT aoi_id, west, south, east, north, CAST(k AS INT) AS z, pow(2e0, k) AS n FROM fx_aoi, range(4, 17) g(k)),
t AS (SELECT aoi_id, z, (floor((east + 180e0) / 360e0 * n) - floor((west + 180e0) / 360e0 * n) + 1) *
 (floor((1e0 - ln(tan(radians(south)) + 1e0 / cos(radians(south))) / pi()) / 2e0 * n) - floor((1e0 - ln(tan(radians(north)) + 1e0 / cos(radians(north))) / pi()) / 2e0 * n) + 1) AS tiles FROM z)
SELECT aoi_id, coalesce(max(CASE WHEN tiles <= 64 THEN z END), 4) AS zoom FROM t GROUP BY aoi_id""")
def p8_zoom(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_aoi").select("aoi_id", g.pick_zoom(c("west"), c("south"), c("east"), c("north"), 64).alias("zoom"))


@query("p9_dem_tile_cover", "fx_aoi", q="""WITH l AS (SELECT aoi_id, south, north, CAST(unnest(generate_series(CAST(floor(west) AS BIGINT), CAST(floor(east) AS BIGINT))) AS INT) AS lo FROM fx_aoi),
t AS (SELECT aoi_id, lo, CAST(unnest(generate_series(CAST(floor(south) AS BIGINT), CAST(floor(north) AS BIGINT))) AS INT) AS la FROM l)
SELECT aoi_id, printf('Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM', CASE WHEN la >= 0 THEN 'N' ELSE 'S' END, abs(la), CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END, abs(lo)) AS tile FROM t""")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    """All one-degree tiles that an area touches."""
    t = view(spark, sf, "fx_aoi").withColumn("lo", F.explode(F.sequence(F.floor("west"), F.floor("east")))).withColumn("la", F.explode(F.sequence(F.floor("south"), F.floor("north"))))
    return t.select("aoi_id", g.dem_tile_name(c("lo").cast("int"), c("la").cast("int")).alias("tile"))


@query("p10_continent", "fx_site", q="""SELECT site_id, CASE WHEN lon >= -170 AND lon < -50 AND lat >= 7 AND lat < 84 THEN 'na' WHEN lon >= -92 AND lon < -32 AND lat >= -56 AND lat < 15 THEN 'sa'
 WHEN lon >= -25 AND lon < 60 AND lat >= -35 AND lat < 38 THEN 'af' WHEN lon >= -12 AND lon < 70 AND lat >= 35 AND lat < 82 THEN 'eu' WHEN lon >= 40 AND lon < 180 AND lat >= -12 AND lat < 60 THEN 'as'
 WHEN lon >= 110 AND lon < 180 AND lat >= -50 AND lat < 0 THEN 'au' WHEN lon < -50 THEN 'na' ELSE 'eu' END AS continent, lon > -180.5e0 AND lon < -64 AND lat + 0.5e0 > 17 AND lat - 0.5e0 < 72 AS us FROM fx_site""")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = c("lon"), c("lat")
    us = g.in_us_envelope(lon, lat - 0.5, lon + 0.5, lat + 0.5)
    return view(spark, sf, "fx_site").select("site_id", g.continent_code(lon, lat).alias("continent"), us.alias("us"))


@query("p4_flat_enu", "fx_site", "fx_aoi", q="""SELECT site_id, round((lon - 10e0) * 111320e0 * cos(radians(lat * 0e0 - 41e0)), 4) + 0e0 AS e, round((lat + 41e0) * 111320e0, 4) + 0e0 AS n, round(lon, 8) + 0e0 AS lon, round(lat, 8) + 0e0 AS lat FROM fx_site""")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    lon0, lat0 = F.lit(10.0), F.lit(-41.0)
    e, n = g.flat_enu(c("lon"), c("lat"), lon0, lat0)
    s = view(spark, sf, "fx_site").withColumns({"e": e, "n": n})
    lon, lat = g.flat_wgs84(c("e"), c("n"), lon0, lat0)
    return s.select("site_id", r("e", 4).alias("e"), r("n", 4).alias("n"), r(lon, 8).alias("lon"), r(lat, 8).alias("lat"))


@query("j4_points_in_aoi", "fx_site", "fx_aoi", q="SELECT site_id, aoi_id FROM fx_site JOIN fx_aoi ON lon >= west AND lon <= east AND lat >= south AND lat <= north")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    return points_in_boxes(view(spark, sf, "fx_site"), view(spark, sf, "fx_aoi"), "lon", "lat", ("west", "south", "east", "north")).select("site_id", "aoi_id")


ITEMS = "(SELECT c_custkey AS item_id, mod(c_custkey * 7, 100) * 1e0 AS cloud, -180e0 + mod(c_custkey * 48271, 360000) / 1e3 AS iw, -80e0 + mod(c_custkey * 16807, 160000) / 1e3 AS i_s FROM customer)"
ITEM_BOX = f"(SELECT item_id, cloud, iw, i_s AS is_, iw + 3e0 AS ie, i_s + 2e0 AS in_ FROM {ITEMS} x)"


@query("j5_bbox_intersects", "fx_aoi", q=f"""SELECT aoi_id, item_id, k FROM (SELECT aoi_id, item_id, row_number() OVER (PARTITION BY aoi_id ORDER BY cloud, item_id) AS k
FROM fx_aoi JOIN {ITEM_BOX} i ON west <= ie AND iw <= east AND south <= in_ AND is_ <= north WHERE cloud < 40) z WHERE k <= 10""")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    """Of the items that meet an area and have little cloud, the ten clearest: the reference's own limit."""
    from geofuse.operators.catalog import clearest_items

    return clearest_items(view(spark, sf, "fx_aoi"), sql(spark, sf, f"SELECT * FROM {ITEM_BOX}"), 40.0, 10).select("aoi_id", "item_id", "k")


@query("j2_nearest_checkpoint", "fx_depth_ts", "fx_checkpoint", q="""WITH s AS (SELECT CASE run_id WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS run_no, CAST(t_s AS DOUBLE) AS time_s FROM fx_depth_ts GROUP BY 1, 2)
SELECT run_no, time_s, ckpt_id, dt, CASE WHEN dt > 1800 THEN 'comparing' ELSE 'compared' END AS status FROM (SELECT s.run_no, s.time_s, ckpt_id, abs(c.time_s - s.time_s) AS dt,
 row_number() OVER (PARTITION BY s.run_no, s.time_s ORDER BY abs(c.time_s - s.time_s), c.time_s, ckpt_id) AS k FROM s JOIN fx_checkpoint c ON s.run_no = c.run_no) m WHERE k = 1""")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    run = F.when(c("run_id") == "A", 0).when(c("run_id") == "N", 1).otherwise(2)
    s = view(spark, sf, "fx_depth_ts").select(run.cast("long").alias("run_no"), c("t_s").cast("double").alias("time_s")).distinct()
    ck = view(spark, sf, "fx_checkpoint").withColumns({"run_no": c("run_no").cast("long"), "time_s": c("time_s").cast("double")})
    m = asof_nearest(s, ck, ["run_no"], "time_s", "ckpt_id", ["ckpt_id"])
    return m.select("run_no", "time_s", "ckpt_id", "dt", F.when(c("dt") > 1800, "comparing").otherwise("compared").alias("status"))


@query("j3_interp_linear", "fx_hydrograph", q="""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, hours ORDER BY sample_id) AS k FROM fx_hydrograph) x WHERE k = 1),
q AS (SELECT o_orderkey AS q_id, mod(o_orderkey, 40) AS series_id, mod(o_orderkey * 131, 900) * 1e0 AS hours FROM orders),
p AS (SELECT q_id, q.series_id, q.hours, max(h.hours) FILTER (WHERE h.hours <= q.hours) AS t0, min(h.hours) FILTER (WHERE h.hours >= q.hours) AS t1 FROM q JOIN h ON q.series_id = h.series_id GROUP BY ALL)
SELECT q_id, round(CASE WHEN t0 IS NULL THEN b.stage_m WHEN t1 IS NULL THEN a.stage_m WHEN t1 > t0 THEN a.stage_m + (b.stage_m - a.stage_m) * ((p.hours - t0) / (t1 - t0)) ELSE a.stage_m END, 6) + 0e0 AS stage_m
FROM p LEFT JOIN h a ON a.series_id = p.series_id AND a.hours = t0 LEFT JOIN h b ON b.series_id = p.series_id AND b.hours = t1""")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    q = sql(spark, sf, "SELECT o_orderkey AS q_id, mod(o_orderkey, 40) AS series_id, mod(o_orderkey * 131, 900) * 1e0 AS hours FROM orders")
    out = interpolated(q, view(spark, sf, "fx_hydrograph"), ["series_id"], "hours", "sample_id", ["stage_m"])
    return out.select("q_id", r("stage_m").alias("stage_m"))

"""Validation, frusta, solves, fusion, and the remaining readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import sql, view
from geofuse.operators import flood as fl
from geofuse.operators import solve as so
from geofuse.plans.asof import asof_nearest
from geofuse.queries.flood import STATS
from geofuse.plans.shared import few
from geofuse.queries.registry import query, r
from geofuse.sources import readers as rd

c = F.col


@query("a12_validation_state", "fx_depth_ts", "fx_checkpoint", q=f"""WITH {STATS}, s AS (SELECT CASE run_id WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS run_no, t_s * 1e0 AS time_s, mass, max_depth, wet_fraction FROM stats),
j AS (SELECT s.*, c.max_depth_m AS cd, c.wet_fraction AS cw, c.mass_m3 AS cm, abs(c.time_s - s.time_s) AS dt, row_number() OVER (PARTITION BY s.run_no, s.time_s ORDER BY abs(c.time_s - s.time_s), c.time_s, ckpt_id) AS k FROM s JOIN fx_checkpoint c ON c.run_no = s.run_no)
SELECT run_no, time_s, CASE WHEN dt > 1800 THEN 'comparing' WHEN abs(mass - cm) / cm <= 0.15e0 AND abs(max_depth - cd) <= 0.35e0 AND abs(wet_fraction - cw) <= 0.12e0 THEN 'validated' ELSE 'diverged' END AS state FROM j WHERE k = 1""")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    """Each state against its nearest checkpoint."""
    run = F.when(c("run_id") == "A", 0).when(c("run_id") == "N", 1).otherwise(2)
    s = fl.depth_stats(view(spark, sf, "fx_depth_ts")).select(run.cast("long").alias("run_no"), c("t_s").cast("double").alias("time_s"), "mass", "max_depth", "wet_fraction")
    k = view(spark, sf, "fx_checkpoint").select(c("run_no").cast("long").alias("run_no"), c("time_s").cast("double").alias("time_s"), "ckpt_id", c("max_depth_m").alias("ck_max_depth"), c("wet_fraction").alias("ck_wet_fraction"), c("mass_m3").alias("ck_mass"))
    near = asof_nearest(s, k, ["run_no"], "time_s", "ckpt_id", ["ck_max_depth", "ck_wet_fraction", "ck_mass"])
    out = fl.compare_checkpoint(near)
    return out.select("run_no", "time_s", F.when(c("dt") > 1800, "comparing").when(c("within"), "validated").otherwise("diverged").alias("state"))


@query("j11_correspond_2d3d", q="""WITH m AS (SELECT DISTINCT mod(l_orderkey, 6) AS ref_frame, l_partkey AS track_id, l_suppkey * 100 + mod(l_orderkey, 97) AS kp_id FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY ref_frame, kp_id, track_id) AS k FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ref_frame, kp_id, track_id) AS t FROM a WHERE k = 1) SELECT ref_frame, track_id, kp_id FROM b WHERE t = 1""")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    m = sql(spark, sf, "SELECT DISTINCT mod(l_orderkey, 6) AS ref_frame, l_partkey AS track_id, l_suppkey * 100 + mod(l_orderkey, 97) AS kp_id FROM lineitem")
    return so.first_matches(m)


def _pairs(spark: SparkSession, sf: str, on_line: int = 1) -> tuple[DataFrame, DataFrame]:
    """Splat centres seen exactly by two cameras, the second the next one; on_line places on for a centre that both see in one direction."""
    s = view(spark, sf, "fx_splat").select(c("splat_id").alias("pair_id"), *[c(k).cast("double").alias(k) for k in "xyz"])
    fa = c("pair_id") % 11
    m = s.select("pair_id", fa.alias("fa"), (fa + 1).alias("fb"), *"xyz")
    depth = lambda f: c("z") + 4 + c(f) % 3
    # Camera f is at (0.8 f, 2.5, -4 - f % 3); centres have two decimals, so whole hundredths tell whether three are in a line.
    whole = lambda e: F.round(100 * e).cast("long")
    in_line = (whole(c("y")) == 250) & (whole(c("x") - 0.8 * c("fa")) * (c("fa") % 3 - c("fb") % 3) == 80 * whole(depth("fa")) / 100)
    m = m.withColumn("fb", F.when(in_line, (c("fa") + on_line) % 12).otherwise(c("fb")))
    m = m.select("pair_id", "fa", "fb", ((c("x") - 0.8 * c("fa")) / depth("fa")).alias("x1"), ((c("y") - 2.5) / depth("fa")).alias("y1"), ((c("x") - 0.8 * c("fb")) / depth("fb")).alias("x2"), ((c("y") - 2.5) / depth("fb")).alias("y2"))
    return m, view(spark, sf, "fx_view").withColumnRenamed("image_id", "frame_id")


@query("m2_triangulate", "fx_splat", q="SELECT splat_id AS pair_id, round(x, 4) + 0e0 AS wx, round(y, 4) + 0e0 AS wy, round(z, 4) + 0e0 AS wz FROM fx_splat")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    """The points must come back. Those on the line through their two cameras are matched with one off it instead."""
    m, poses = _pairs(spark, sf, on_line=4)
    return so.triangulate(m, poses).select("pair_id", r("wx", 4).alias("wx"), r("wy", 4).alias("wy"), r("wz", 4).alias("wz"))


@query("m2_good_points", "fx_splat", q="""WITH p AS (SELECT splat_id, x, y, z, 0.8e0 * mod(splat_id, 11) AS ax, 0.8e0 * (mod(splat_id, 11) + 1) AS bx, -(4e0 + mod(mod(splat_id, 11), 3)) AS az, -(4e0 + mod(mod(splat_id, 11) + 1, 3)) AS bz FROM fx_splat),
v AS (SELECT splat_id, x - ax AS ux, y - 2.5e0 AS uy, z - az AS uz, x - bx AS wx, y - 2.5e0 AS wy, z - bz AS wz FROM p)
SELECT splat_id AS pair_id FROM v WHERE degrees(acos(least(1e0, (ux * wx + uy * wy + uz * wz) / (sqrt(ux * ux + uy * uy + uz * uz) * sqrt(wx * wx + wy * wy + wz * wz))))) >= 1e0""")
def m2_good(spark: SparkSession, sf: str) -> DataFrame:
    m, poses = _pairs(spark, sf)
    return so.good_points(so.triangulate(m, poses), poses).select("pair_id")


@query("m1_two_view_verify")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh match is moved off: it must not be an inlier."""
    m, _ = _pairs(spark, sf)
    off = F.when(c("pair_id") % 7 == 0, 0.3).otherwise(0.0)
    return so.two_view_verify(m.withColumns({"x2": c("x2") + off, "y2": c("y2") - off}), 800.0)


@query("a28_ground_plane")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence points pressed to a tilted floor, a fifth of them left above it."""
    e = view(spark, sf, "fx_evidence").select(c("x").cast("double").alias("x"), c("y").cast("double").alias("y"), c("r").cast("double").alias("k"))
    z = 0.1 * c("x") - 0.05 * c("y") + F.when(c("k") % 5 == 0, 0.5 + c("k") / 100).otherwise(0.0)
    return so.ground_plane(e.withColumn("z", z).withColumn("key", F.struct("x", "y", "k")), "key")


@query("a30_tsdf_fuse", "fx_splat", "fx_view", q="""WITH vox AS (SELECT DISTINCT CAST(floor(x * 4) AS BIGINT) AS vx, CAST(floor(y * 4) AS BIGINT) AS vy, CAST(floor(z * 4) AS BIGINT) AS vz FROM fx_splat),
q AS (SELECT vx, vy, vz, image_id, (vx + 0.5e0) / 4 + tx AS cx, (vy + 0.5e0) / 4 + ty AS cy, (vz + 0.5e0) / 4 + tz AS cz, f, width, height FROM vox, fx_view),
p AS (SELECT *, CAST(floor(f * cx / cz + width / 2) AS INT) AS px, CAST(floor(f * cy / cz + height / 2) AS INT) AS py FROM q WHERE cz > 1e-4),
s AS (SELECT vx, vy, vz, 3e0 + mod(px * 7 + py * 3, 50) / 10e0 - cz AS sdf, 0.2e0 + mod(px + py, 8) / 10e0 AS cs FROM p WHERE px >= 0 AND py >= 0 AND px < 640 AND py < 480 AND mod(px + py, 3) <> 0)
SELECT vx, vy, vz, round(sum(least(sdf, 0.75e0) * cs) / sum(cs), 10) + 0e0 AS sdf, round(sum(cs), 6) AS weight FROM s WHERE cs >= 0.2e0 AND sdf >= -0.75e0 GROUP BY ALL""")
def a30(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels that hold a splat, against depth images in closed form (a third of the pixels empty)."""
    s = view(spark, sf, "fx_splat").select(*[F.floor(c(k) * 4).alias(f"v{k}") for k in "xyz"]).distinct()
    vox = s.withColumns({k: (c(f"v{k}") + 0.5) / 4 for k in "xyz"})
    views = view(spark, sf, "fx_view")
    d = views.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(479))).alias("py")).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(639))))
    d = d.filter((c("px") + c("py")) % 3 != 0).select("image_id", "py", "px", (3 + (c("px") * 7 + c("py") * 3) % 50 / 10).alias("depth"), (0.2 + (c("px") + c("py")) % 8 / 10).alias("cos"))
    out = so.tsdf_fuse(vox, d, views, 0.75)
    return out.select("vx", "vy", "vz", r("sdf", 10).alias("sdf"), r("weight").alias("weight"))


@query("a30_tsdf_colours", "fx_splat", "fx_view", q="""WITH vox AS (SELECT DISTINCT CAST(floor(x * 4) AS BIGINT) AS vx, CAST(floor(y * 4) AS BIGINT) AS vy, CAST(floor(z * 4) AS BIGINT) AS vz FROM fx_splat),
q AS (SELECT vx, vy, vz, image_id, (vx + 0.5e0) / 4 + tx AS cx, (vy + 0.5e0) / 4 + ty AS cy, (vz + 0.5e0) / 4 + tz AS cz, f, width, height FROM vox, fx_view),
p AS (SELECT *, CAST(floor(f * cx / cz + width / 2) AS INT) AS px, CAST(floor(f * cy / cz + height / 2) AS INT) AS py FROM q WHERE cz > 1e-4),
s AS (SELECT vx, vy, vz, 3e0 + mod(px * 7 + py * 3, 50) / 10e0 - cz AS sdf, 0.2e0 + mod(px + py, 8) / 10e0 AS cs, mod(px, 256) / 255e0 AS r, mod(py, 256) / 255e0 AS g FROM p WHERE px >= 0 AND py >= 0 AND px < 640 AND py < 480 AND mod(px + py, 3) <> 0)
SELECT vx, vy, vz, round(sum(least(sdf, 0.75e0) * cs) / sum(cs), 10) + 0e0 AS sdf, round(sum(cs), 6) AS weight, round(coalesce(sum(CASE WHEN sdf > -0.75e0 AND sdf < 0.75e0 THEN cs * r END) / sum(CASE WHEN sdf > -0.75e0 AND sdf < 0.75e0 THEN cs END), 0e0), 9) + 0e0 AS r,
 round(coalesce(sum(CASE WHEN sdf > -0.75e0 AND sdf < 0.75e0 THEN cs * g END) / sum(CASE WHEN sdf > -0.75e0 AND sdf < 0.75e0 THEN cs END), 0e0), 9) + 0e0 AS g FROM s WHERE cs >= 0.2e0 AND sdf >= -0.75e0 GROUP BY ALL""")
def a30_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels that hold a splat, against depth images and colours in closed form (a third of the pixels empty)."""
    s = view(spark, sf, "fx_splat").select(*[F.floor(c(k) * 4).alias(f"v{k}") for k in "xyz"]).distinct()
    vox = s.withColumns({k: (c(f"v{k}") + 0.5) / 4 for k in "xyz"})
    views = view(spark, sf, "fx_view")
    d = views.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(479))).alias("py")).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(639))))
    d = d.filter((c("px") + c("py")) % 3 != 0).select("image_id", "py", "px", (3 + (c("px") * 7 + c("py") * 3) % 50 / 10).alias("depth"), (0.2 + (c("px") + c("py")) % 8 / 10).alias("cos"), (c("px") % 256 / 255).alias("r"), (c("py") % 256 / 255).alias("g"))
    out = so.tsdf_fuse(vox, d, views, 0.75, colours=("r", "g"))
    return out.select("vx", "vy", "vz", r("sdf", 10).alias("sdf"), r("weight").alias("weight"), r("r", 9).alias("r"), r("g", 9).alias("g"))


@query("p20_camera_frustum", "fx_obs", "fx_view", q="""SELECT o.solver, v.image_id, round(0.8e0 * v.image_id, 6) + 0e0 AS cx, round(-v.tz, 6) + 0e0 AS cz, round(0.8e0 * v.image_id + least(2e0, greatest(0.05e0, 0.12e0 * me)) * 320 / f, 6) + 0e0 AS corner_x
FROM (SELECT solver, percentile_disc(0.5) WITHIN GROUP (ORDER BY err_px * 10 DESC) AS me FROM fx_obs GROUP BY solver) o, fx_view v""")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    """Centres and a corner of each view's frustum, as deep as an eighth of the model's median distance."""
    from geofuse.functions.camera import centre
    from geofuse.functions.splat import rotation

    o = view(spark, sf, "fx_obs").groupBy("solver").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY err_px * 10 DESC)").alias("me"))
    d = F.least(F.lit(2.0), F.greatest(F.lit(0.05), 0.12 * c("me")))
    b = view(spark, sf, "fx_view").join(few(o, what="solvers")).withColumn("d", d)
    q, t = tuple(c(k) for k in ("qw", "qx", "qy", "qz")), tuple(c(k) for k in ("tx", "ty", "tz"))
    m, at = rotation(*q), centre(q, t)
    ray = (c("width") / 2 / c("f") * c("d"), c("height") / 2 / c("f") * c("d"), c("d"))
    corner = at[0] + m[0][0] * ray[0] + m[1][0] * ray[1] + m[2][0] * ray[2]
    return b.select("solver", "image_id", r(at[0]).alias("cx"), r(at[2]).alias("cz"), r(corner).alias("corner_x"))


@query("s3_mrk", "fx_telemetry", q="SELECT sample_id, round(lat_deg, 6) AS lat, round(lon_deg, 6) AS lon, round(height_m, 3) AS h, greatest(abs(std_n), 0.01e0) AS std_n, greatest(abs(std_u), 0.01e0) AS std_u FROM fx_telemetry")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    """Marker lines by field order: number, time, latitude, longitude, height, deviations north, east, up."""
    line = F.format_string("%d\t%.3f\t%.6f\t%.6f\t%.3f\t%s\t%s\t%s", "sample_id", "unix_s", "lat_deg", "lon_deg", "height_m", "std_n", "std_e", "std_u")
    m = rd.mrk(view(spark, sf, "fx_telemetry").select(line.alias("value")))
    return m.select("sample_id", r("lat_deg").alias("lat"), r("lon_deg").alias("lon"), r("height_m", 3).alias("h"), "std_n", "std_u")


@query("s4_pos", "fx_telemetry", q="SELECT round(lat_deg, 6) AS lat, round(lon_deg, 6) AS lon, round(height_m, 3) AS h, greatest(std_e, 0.02e0) AS std_e, count(*) AS n FROM fx_telemetry GROUP BY ALL")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a date, a time and positions in either order."""
    t = view(spark, sf, "fx_telemetry")
    when = F.date_format(F.timestamp_seconds("unix_s"), "yyyy/MM/dd HH:mm:ss")
    swap = c("sample_id") % 2 == 0
    line = F.format_string("%s  %.6f %.6f %.3f %s", when, F.when(swap, c("lon_deg")).otherwise(c("lat_deg")), F.when(swap, c("lat_deg")).otherwise(c("lon_deg")), "height_m", "std_e")
    p = rd.pos(t.select(line.alias("value")).unionByName(t.limit(1).select(F.lit("% a comment").alias("value"))))
    return p.groupBy(r("lat_deg").alias("lat"), r("lon_deg").alias("lon"), r("height_m", 3).alias("h"), "std_e").agg(F.count(F.lit(1)).alias("n"))


@query("s6_kml", "fx_site", q="SELECT round(lon, 4) + 0e0 AS lon, round(lat, 4) + 0e0 AS lat, count(*) AS n FROM fx_site GROUP BY ALL")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    """A file a block of sites; every coordinate of every placemark."""
    s = view(spark, sf, "fx_site").withColumn("t", F.format_string("%.4f,%.4f,7", "lon", "lat")).groupBy(F.floor(c("site_id") / 40).alias("b")).agg(F.array_join(F.collect_list("t"), "\n ").alias("t"))
    k = rd.kml(s.select(F.concat(F.lit("<kml><Placemark><LineString><coordinates>\n"), c("t"), F.lit("</coordinates></LineString></Placemark></kml>")).alias("value")))
    return k.groupBy(r("lon_deg", 4).alias("lon"), r("lat_deg", 4).alias("lat")).agg(F.count(F.lit(1)).alias("n"))


@query("s23_synthetic_bed", "fx_bed", "fx_aoi", q="SELECT aoi_id, CAST(b.row AS BIGINT) AS row, CAST(b.col AS BIGINT) AS col, round(z, 6) + 0e0 AS z FROM fx_aoi, fx_bed b")
def s23(spark: SparkSession, sf: str) -> DataFrame:
    """The closed-form bed for every area that has no elevation."""
    from geofuse.operators.bed import synthetic_bed

    return synthetic_bed(view(spark, sf, "fx_aoi").select("aoi_id"), 96, 72).select("aoi_id", "row", "col", r("z").alias("z"))


@query("m3_densify_matches")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the matches uncertain, a seventh moved off by many pixels."""
    m, poses = _pairs(spark, sf)
    off = F.when(c("pair_id") % 7 == 0, 0.3).otherwise(0.0)
    m = m.withColumns({"y2": c("y2") - off, "certainty": F.when(c("pair_id") % 3 == 0, 0.4).otherwise(0.9)})
    return so.densify_matches(m, poses, 800.0).select("pair_id", "fa", "fb", "wx", "wy", "wz")


@query("p16_rotate_sh")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    """Eight coefficients a channel, turned thirty degrees about up."""
    from geofuse.functions.harmonics import rotate_sh
    from geofuse.functions.splat import axis_rotation

    rest = F.array(*[((c("splat_id") * (k + 3)) % 101 / 101 - 0.5) for k in range(24)])
    s = view(spark, sf, "fx_splat").select("splat_id", rest.alias("rest"))
    return s.select("splat_id", "rest", rotate_sh(c("rest"), 8, axis_rotation((0, 0, 1), 30)).alias("turned"))

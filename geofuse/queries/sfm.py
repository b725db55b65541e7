"""Images, matches, sparse models and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import sql, view
from geofuse.functions import camera as cam
from geofuse.operators import sfm as op
from geofuse.queries.registry import query, r

c = F.col
KP = "kp AS (SELECT frame_id, kp_id, CAST(sum(CAST(v AS HUGEINT) << bit) % 9223372036854775808 AS BIGINT) AS lo, max(CASE WHEN bit = 63 THEN v END) AS top FROM fx_bits GROUP BY 1, 2)"
DIST = "bit_count(xor(a.lo, b.lo)) + CASE WHEN a.top <> b.top THEN 1 ELSE 0 END"
MATCH = f"""{KP}, m AS (SELECT a.frame_id AS fa, b.frame_id AS fb, a.kp_id AS i, b.kp_id AS j, CAST({DIST} AS INT) AS d FROM kp a JOIN kp b ON b.frame_id = a.frame_id + 1),
w AS (SELECT *, row_number() OVER (PARTITION BY fa, fb, i ORDER BY d, j) AS k, row_number() OVER (PARTITION BY fa, fb, j ORDER BY d, i) AS q FROM m),
matched AS (SELECT x.fa, x.fb, x.i, x.j, x.d FROM w x LEFT JOIN w y ON y.fa = x.fa AND y.i = x.i AND y.k = 2 WHERE x.k = 1 AND x.d <= 26 AND (y.d IS NULL OR x.d <= 0.95e0 * y.d) AND x.q = 1)"""


def keypoints(spark: SparkSession, sf: str) -> DataFrame:
    return op.pack_bits(view(spark, sf, "fx_bits"))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    k = keypoints(spark, sf)
    frames = k.select("frame_id").distinct()
    return op.match_descriptors(k, frames.select(c("frame_id").alias("fa"), (c("frame_id") + 1).alias("fb")), 0.95, 26)


@query("j7_match_descriptors", "fx_bits", q=f"WITH {MATCH} SELECT fa, fb, i, j, d FROM matched")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).select("fa", "fb", "i", "j", c("d").cast("int").alias("d"))


@query("a24_pair_displacement", "fx_bits", q=f"""WITH {MATCH}, s AS (SELECT fa, fb, sqrt(pow(mod(i * 37, 640) - mod(j * 37, 640), 2) + pow(mod(i * 53, 480) - mod(j * 53, 480), 2)) AS s FROM matched)
SELECT fa, fb, round(quantile_disc(s, 0.5 ORDER BY s DESC), 6) AS median_px, count(*) AS matches, count(*) >= 60 AND quantile_disc(s, 0.5 ORDER BY s DESC) >= 4 AS seed FROM s GROUP BY fa, fb""".replace("quantile_disc(s, 0.5 ORDER BY s DESC)", "percentile_disc(0.5) WITHIN GROUP (ORDER BY s DESC)"))
def a24(spark: SparkSession, sf: str) -> DataFrame:
    k = keypoints(spark, sf).select("kp_id", (c("kp_id") * 37 % 640).alias("x"), (c("kp_id") * 53 % 480).alias("y"))
    d = op.pair_displacement(matches(spark, sf), k)
    return d.select("fa", "fb", r("median_px").alias("median_px"), "matches", "seed")


@query("g6_build_tracks", "fx_bits", q=f"""WITH RECURSIVE {MATCH}, e AS (SELECT i AS u, j AS v FROM matched UNION SELECT j, i FROM matched), t(n, root) AS (SELECT u, u FROM e UNION SELECT e.v, t.root FROM t JOIN e ON e.u = t.n),
l AS (SELECT n AS kp_id, min(root) AS track_id FROM t GROUP BY n), x AS (SELECT track_id, kp_id, mod(kp_id, 4) AS frame_id FROM l) SELECT * FROM x WHERE track_id NOT IN (SELECT track_id FROM x GROUP BY track_id, frame_id HAVING count(*) > 1)""")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return op.build_tracks(matches(spark, sf), keypoints(spark, sf))


PX = "fx_pixel"
LAP = """l AS (SELECT a.image_id, n.g + s.g + e.g + w.g - 4 * a.g AS lap FROM fx_pixel a JOIN fx_pixel n ON n.image_id = a.image_id AND n.y = a.y + 1 AND n.x = a.x JOIN fx_pixel s ON s.image_id = a.image_id AND s.y = a.y - 1 AND s.x = a.x
 JOIN fx_pixel e ON e.image_id = a.image_id AND e.y = a.y AND e.x = a.x + 1 JOIN fx_pixel w ON w.image_id = a.image_id AND w.y = a.y AND w.x = a.x - 1), sharp AS (SELECT image_id, avg(lap * lap) - avg(lap) * avg(lap) AS score FROM l GROUP BY image_id)"""
FRAMES = f"{LAP}, fr AS (SELECT image_id, mod(image_id, 5) AS capture, CASE WHEN mod(image_id, 17) = 3 THEN -1e0 ELSE score END AS score FROM sharp)"
KEPT = f"""{FRAMES}, v AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY score, image_id) AS k, count(*) OVER (PARTITION BY capture) AS n FROM fr WHERE score >= 0),
kept AS (SELECT image_id, capture FROM v WHERE k > least(floor(n * 0.3e0), greatest(n - 3, 0)))"""
EVEN = f"""{KEPT}, o AS (SELECT image_id, capture, row_number() OVER (PARTITION BY capture ORDER BY image_id) - 1 AS i, count(*) OVER (PARTITION BY capture) AS n FROM kept),
even AS (SELECT image_id, capture FROM o WHERE n <= 20 OR i IN (SELECT floor(k * (n - 1) / 19e0 + 0.5e0) FROM range(0, 20) z(k)))"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    s = op.sharpness(view(spark, sf, PX))
    return s.select("image_id", (c("image_id") % 5).alias("capture"), F.when(c("image_id") % 17 == 3, -1.0).otherwise(c("score")).alias("score"))


@query("a25_sharpness", PX, q=f"WITH {LAP} SELECT image_id, round(score, 4) AS score FROM sharp")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return op.sharpness(view(spark, sf, PX)).select("image_id", r("score", 4).alias("score"))


@query("w7_reject_blurriest", PX, q=f"WITH {KEPT} SELECT image_id, capture FROM kept")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return op.reject_blurriest(frames(spark, sf), 0.3).select("image_id", "capture")


@query("w8_even_subsample", PX, q=f"WITH {EVEN} SELECT image_id, capture FROM even")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return op.even_subsample(op.reject_blurriest(frames(spark, sf), 0.3), 20).select("image_id", "capture")


@query("a26_gating_report", PX, q=f"""WITH {EVEN} SELECT capture, count(*) AS total, count(*) FILTER (WHERE score < 0) AS unreadable, CAST(least(floor(count(*) FILTER (WHERE score >= 0) * 0.3e0), greatest(count(*) FILTER (WHERE score >= 0) - 3, 0)) AS BIGINT) AS blur_rejected,
 (SELECT count(*) FROM even WHERE even.capture = fr.capture) AS kept FROM fr GROUP BY capture""")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    return op.gating_report(frames(spark, sf), 0.3, 20)


@query("u4_rejected_frames", PX, q=f"WITH {KEPT} SELECT image_id FROM fr WHERE image_id NOT IN (SELECT image_id FROM kept)")
def u4(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return f.select("image_id").exceptAll(op.reject_blurriest(f, 0.3).select("image_id"))


@query("w6_nms3x3", PX, q="SELECT a.image_id, a.y, a.x, a.g FROM fx_pixel a WHERE NOT EXISTS (SELECT 1 FROM fx_pixel b WHERE b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.g > a.g)")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return op.nms(view(spark, sf, PX))


@query("w5_grid_spread", q="""WITH k AS (SELECT mod(l_suppkey, 5) AS frame_id, l_orderkey * 8 + l_linenumber AS kp_id, mod(l_partkey * 37, 640) * 1e0 AS x, mod(l_orderkey * 53, 480) * 1e0 AS y, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
d AS (SELECT *, count(*) OVER (PARTITION BY frame_id) AS n, least(floor(y / (480e0 / 9)), 8) * 12 + least(floor(x / (640e0 / 12)), 11) AS cell FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY frame_id, cell ORDER BY score DESC, kp_id, x, y) AS best FROM d), z AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN best = 1 THEN 0 ELSE 1 END, score DESC, kp_id, x, y) AS q FROM b)
SELECT frame_id, kp_id, x, y FROM z WHERE n <= 100 OR best = 1 OR q <= 100""")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    k = sql(spark, sf, "SELECT mod(l_suppkey, 5) AS frame_id, l_orderkey * 8 + l_linenumber AS id, mod(l_partkey * 37, 640) * 1e0 AS x, mod(l_orderkey * 53, 480) * 1e0 AS y, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2, 3, 4")
    k = k.withColumn("kp_id", F.struct("id", "x", "y"))
    return op.grid_spread(k, 640, 480, 100).select("frame_id", c("id").alias("kp_id"), "x", "y")


NAMES = "(SELECT mod(o_custkey, 7) AS capture, CASE WHEN mod(o_custkey, 7) = 2 AND mod(o_orderkey, 2) = 0 THEN 'photo.jpg' ELSE printf('IMG_%08d.jpg', CASE WHEN mod(o_custkey, 7) = 3 THEN o_orderkey * 9 ELSE CAST(floor(o_orderkey / 4) AS BIGINT) END) END AS name FROM orders)"


@query("w1_sequential_names", q=f"""WITH n AS (SELECT *, regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '[^0-9]', '', 'g') AS dg FROM {NAMES} x), m AS (SELECT capture, name, CASE WHEN length(dg) >= 3 THEN CAST(dg AS BIGINT) END AS num FROM n),
g AS (SELECT capture, num - lag(num) OVER (PARTITION BY capture ORDER BY name) AS gap FROM m WHERE num IS NOT NULL), s AS (SELECT capture, count(*) AS numbered, count(*) FILTER (WHERE gap BETWEEN 1 AND 5) AS small FROM g GROUP BY capture), t AS (SELECT capture, count(*) AS n FROM m GROUP BY capture)
SELECT capture, n, n >= 8 AND numbered >= floor(n * 3 / 4e0) AND small > (numbered - 1) * 0.7e0 AS sequential FROM t JOIN s USING (capture)""")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    n = sql(spark, sf, "SELECT mod(o_custkey, 7) AS capture, CASE WHEN mod(o_custkey, 7) = 2 AND mod(o_orderkey, 2) = 0 THEN 'photo.jpg' ELSE printf('IMG_%08d.jpg', CASE WHEN mod(o_custkey, 7) = 3 THEN o_orderkey * 9 ELSE CAST(floor(o_orderkey / 4) AS BIGINT) END) END AS name FROM orders")
    return op.sequential(n)


@query("a20_capture_profile", q="""WITH t AS (SELECT o_custkey AS k, count(*) * 30 AS n FROM orders GROUP BY 1) SELECT k, CASE WHEN mod(k, 11) = 0 THEN 'gps-rtk-drone' WHEN mod(k, 7) = 0 THEN 'fisheye-or-rolling-shutter' WHEN n >= 400 AND (mod(k, 5) = 0 OR mod(k, 2) <> 0) THEN 'large-scene'
 WHEN mod(k, 2) = 0 AND n >= 120 THEN 'long-video' WHEN n >= 400 THEN 'large-scene' WHEN mod(k, 2) = 0 AND n >= 40 THEN 'ordered-video' ELSE 'unordered-photos' END AS profile FROM t""")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    t = sql(spark, sf, "SELECT o_custkey AS k, count(*) * 30 AS n FROM orders GROUP BY 1")
    return t.select("k", op.capture_profile(c("k") % 11 == 0, c("k") % 7 == 0, F.lit(False), c("k") % 5 == 0, c("k") % 2 == 0, c("n")).alias("profile"))


@query("j13_reference_pairs", PX, q="""WITH i AS (SELECT capture, row_number() OVER (PARTITION BY capture ORDER BY image_id) - 1 AS i, count(*) OVER (PARTITION BY capture) AS n FROM (SELECT DISTINCT image_id, mod(image_id, 5) AS capture FROM fx_pixel) d),
s AS (SELECT *, greatest(1, ceil(n * 0.2e0)) AS refs, greatest(1, floor(n / greatest(1, ceil(n * 0.2e0)))) AS step FROM i), q AS (SELECT capture, i, n, i + o AS j FROM s, range(-3, 4) z(o) WHERE i % step = 0 AND floor(i / step) < refs AND o <> 0)
SELECT DISTINCT capture, least(i, j) AS a, greatest(i, j) AS b FROM q WHERE j >= 0 AND j < n""")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    i = view(spark, sf, PX).select("image_id").distinct().withColumn("capture", c("image_id") % 5)
    return op.reference_pairs(i, 0.2, 3).select("capture", c("a").cast("long").alias("a"), c("b").cast("long").alias("b"))


SCORE = """p AS (SELECT solver, point_id, round(avg(err_px), 9) AS err, count(*) AS track FROM fx_obs GROUP BY 1, 2), q AS (SELECT solver, percentile_disc(0.5) WITHIN GROUP (ORDER BY err DESC) AS me, avg(track) AS mt, count(*) FILTER (WHERE track >= 2 AND err <= 4) * 1e0 / count(*) AS good FROM p GROUP BY solver),
i AS (SELECT solver, count(DISTINCT image_id) AS images FROM fx_obs GROUP BY solver), s AS (SELECT *, least(1e0, images * 1e0 / greatest(80, images)) AS reg FROM q JOIN i USING (solver)), l AS (SELECT *, least(1e0, reg * least(1e0, mt / 4)) AS lp FROM s),
score AS (SELECT *, 0.30e0 * reg + 0.22e0 * (1 - least(1e0, me / 8)) + 0.18e0 * least(1e0, mt / 6) + 0.18e0 * good + 0.12e0 * lp AS comp FROM l)"""
PASSES = "reg >= 0.35e0 AND me <= 6 AND mt >= 1.5e0 AND good >= 0.25e0 AND comp >= 0.28e0"


@query("a18_hypothesis_score", "fx_obs", q=f"WITH {SCORE} SELECT solver, images, round(me, 6) AS median_err, round(mt, 6) AS mean_track, round(good, 6) AS good, round(comp, 6) AS composite, {PASSES} AS passes FROM score")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    s = op.hypothesis_scores(view(spark, sf, "fx_obs"), 80)
    return s.select("solver", "images", r("median_err").alias("median_err"), r("mean_track").alias("mean_track"), r("good").alias("good"), r("composite").alias("composite"), "passes")


@query("a19_select_hypothesis", "fx_obs", q=f"WITH {SCORE} SELECT solver FROM score WHERE {PASSES} ORDER BY comp DESC, solver LIMIT 1")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    s = op.hypothesis_scores(view(spark, sf, "fx_obs"), 80).filter("passes")
    return s.orderBy(c("composite").desc(), "solver").limit(1).select("solver")


@query("a23_sfm_rms", "fx_obs", q="SELECT solver, image_id, round(sqrt(avg(err_px * err_px)), 6) AS rms_px, count(*) AS n FROM fx_obs GROUP BY solver, image_id")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_obs").groupBy("solver", "image_id").agg(r(F.sqrt(F.avg(c("err_px") * c("err_px")))).alias("rms_px"), F.count(F.lit(1)).alias("n"))


@query("a23_prune_obs", "fx_obs", q="WITH o AS (SELECT * FROM fx_obs WHERE err_px < 2) SELECT solver, image_id, point_id FROM o WHERE (solver, point_id) IN (SELECT (solver, point_id) FROM o GROUP BY solver, point_id HAVING count(*) >= 2)")
def a23_prune(spark: SparkSession, sf: str) -> DataFrame:
    return op.prune_obs(view(spark, sf, "fx_obs"), 2.0).select("solver", "image_id", "point_id")


@query("j12_registered_obs", "fx_obs", "fx_view", q="SELECT solver, image_id, count(*) AS n FROM fx_obs WHERE image_id IN (SELECT image_id FROM fx_view) GROUP BY ALL")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    kept = view(spark, sf, "fx_obs").join(view(spark, sf, "fx_view").select("image_id"), "image_id", "left_semi")
    return kept.groupBy("solver", "image_id").agg(F.count(F.lit(1)).alias("n"))


@query("j12_untracked_matches", "fx_bits", q=f"WITH {MATCH} SELECT i, j FROM matched WHERE mod(i, 3) <> 0 AND mod(j, 3) <> 0")
def j12_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Matches neither end of which has a track (every third keypoint has one here)."""
    tracked = keypoints(spark, sf).filter("mod(kp_id, 3) = 0").select("kp_id")
    m = matches(spark, sf).join(tracked.withColumnRenamed("kp_id", "i"), "i", "left_anti")
    return m.join(tracked.withColumnRenamed("kp_id", "j"), "j", "left_anti").select("i", "j")


@query("j9_view_camera", "fx_obs", "fx_view", q="SELECT o.solver, v.camera_id, count(*) AS n FROM fx_obs o JOIN fx_view v ON v.image_id = mod(o.image_id, 12) GROUP BY ALL")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    o = view(spark, sf, "fx_obs").withColumn("image_id", c("image_id") % 12)
    return o.join(view(spark, sf, "fx_view").select("image_id", "camera_id"), "image_id").groupBy("solver", "camera_id").agg(F.count(F.lit(1)).alias("n"))


@query("o4_best_tracks", "fx_obs", q="SELECT solver, point_id, n FROM (SELECT solver, point_id, count(*) AS n FROM fx_obs GROUP BY 1, 2) x ORDER BY n DESC, solver, point_id LIMIT 600")
def o4(spark: SparkSession, sf: str) -> DataFrame:
    n = view(spark, sf, "fx_obs").groupBy("solver", "point_id").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(c("n").desc(), "solver", "point_id").limit(600)


@query("p21_parallax_sampson", "fx_splat", q="""WITH s AS (SELECT splat_id, x / (z + 4) AS x1, y / (z + 4) AS y1, (x - 1e0) / (z + 4) AS x2, y / (z + 4) + 0.001e0 AS y2, x, y, z + 4 AS z FROM fx_splat)
SELECT splat_id, round((y1 - y2) * (y1 - y2) / 2, 12) + 0e0 AS sampson, round(acos(least(1e0, greatest(-1e0, (x * (x - 1) + y * y + z * z) / (sqrt(x * x + y * y + z * z) * sqrt((x - 1) * (x - 1) + y * y + z * z))))), 5) + 0e0 AS angle FROM s""")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    """Two views one metre apart: the essential matrix of a shift along x."""
    s = view(spark, sf, "fx_splat").select("splat_id", c("x").cast("double"), c("y").cast("double"), (c("z") + 4).cast("double").alias("z"))
    zero, one = F.lit(0.0), F.lit(1.0)
    e = [[zero, zero, zero], [zero, zero, one], [zero, -one, zero]]
    d = cam.sampson(e, c("x") / c("z"), c("y") / c("z"), (c("x") - 1) / c("z"), c("y") / c("z") + 0.001)
    a = cam.parallax((zero, zero, zero), (one, zero, zero), (c("x"), c("y"), c("z")))
    return s.select("splat_id", r(d, 12).alias("sampson"), r(a, 5).alias("angle"))


# Meshes ---------------------------------------------------------------------------------------------------------
T = "fx_triangle"
VERT = "v AS (SELECT v, mod(v * 31, 97) / 10e0 AS x, mod(v * 17, 89) / 10e0 AS y, mod(v * 7, 83) / 10e0 AS z FROM (SELECT v0 AS v FROM fx_triangle UNION SELECT v1 FROM fx_triangle UNION SELECT v2 FROM fx_triangle) u)"


def vertices(t: DataFrame) -> DataFrame:
    v = t.select(F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct()
    return v.select("v", (c("v") * 31 % 97 / 10).alias("x"), (c("v") * 17 % 89 / 10).alias("y"), (c("v") * 7 % 83 / 10).alias("z"))


@query("g1_components", T, q="SELECT tri_id, count(*) OVER (PARTITION BY truth_component) AS size, min(v0) OVER (PARTITION BY truth_component) AS component FROM fx_triangle")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return op.mesh_components(view(spark, sf, T)).select("tri_id", "size", "component")


@query("g1_keep_large", T, q="SELECT tri_id FROM (SELECT tri_id, count(*) OVER (PARTITION BY truth_component) AS n FROM fx_triangle) x WHERE n >= ceil(0.5e0 * (SELECT max(n) FROM (SELECT count(*) AS n FROM fx_triangle GROUP BY truth_component) y))")
def g1_keep(spark: SparkSession, sf: str) -> DataFrame:
    return op.keep_large(view(spark, sf, T), 0.5).select("tri_id")


@query("g2_vertex_normals", T, q=f"""WITH {VERT}, t AS (SELECT f.v0, f.v1, f.v2, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, d.x - a.x AS wx, d.y - a.y AS wy, d.z - a.z AS wz FROM fx_triangle f JOIN v a ON a.v = v0 JOIN v b ON b.v = v1 JOIN v d ON d.v = v2),
n AS (SELECT unnest([v0, v1, v2]) AS v, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz FROM t), s AS (SELECT v, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM n GROUP BY v)
SELECT v, round(CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-12 THEN nx / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0e0 END, 6) + 0e0 AS nx, round(CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-12 THEN nz / sqrt(nx * nx + ny * ny + nz * nz) ELSE 1e0 END, 6) + 0e0 AS nz FROM s""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, T)
    return op.vertex_normals(t, vertices(t)).select("v", r("nx").alias("nx"), r("nz").alias("nz"))


@query("g3_laplacian_smooth", T, q=f"""WITH {VERT}, e AS (SELECT v0 AS a, v1 AS b FROM fx_triangle UNION SELECT v1, v2 FROM fx_triangle UNION SELECT v2, v0 FROM fx_triangle UNION SELECT v1, v0 FROM fx_triangle UNION SELECT v2, v1 FROM fx_triangle UNION SELECT v0, v2 FROM fx_triangle),
m AS (SELECT a, avg(x) AS mx, avg(z) AS mz FROM e JOIN v ON v.v = b GROUP BY a) SELECT v, round(x + 0.4e0 * (mx - x), 9) + 0e0 AS x, round(z + 0.4e0 * (mz - z), 9) + 0e0 AS z FROM v JOIN m ON a = v""")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, T)
    return op.laplacian_smooth(t, vertices(t), 0.4).select("v", r("x", 9).alias("x"), r("z", 9).alias("z"))


@query("g4_compact_vertices", T, q=f"WITH {VERT} SELECT v, row_number() OVER (ORDER BY v) - 1 AS new_v FROM v WHERE v IN (SELECT unnest([v0, v1, v2]) FROM fx_triangle WHERE mod(tri_id, 3) = 0)")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, T)
    return op.compact_vertices(t.filter("mod(tri_id, 3) = 0"), vertices(t))



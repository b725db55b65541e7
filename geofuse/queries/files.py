"""Binary and model files written from the given tables and read back, depth images, surfaces and alignment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import sql, view
from geofuse.functions.splat import axis_rotation
from geofuse.operators import catalog as cat
from geofuse.operators import cloud as cl
from geofuse.operators import sfm
from geofuse.operators import surface as su
from geofuse.plans.rank import stride_sample
from geofuse.plans.shared import new_dir, stored
from geofuse.queries.cloud import COV, DEC, ROT, splats
from geofuse.queries.registry import query, r
from geofuse.sources import binary as bi
from geofuse.sources import model as md
from geofuse.sources.files import save

c = F.col
S = "fx_splat"


@query("s16_read_ply", S, q="SELECT mod(splat_id, 4) AS part, round(x, 3) + 0e0 AS x, round(y, 3) + 0e0 AS y, round(z, 3) + 0e0 AS z, round(qy, 3) + 0e0 AS qy, round(s1, 3) + 0e0 AS s1, round(dc2, 2) + 0e0 AS dc2, 9 AS higher FROM fx_splat")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    """PLY files of a few hundred splats, written to the shared folder and read in ranges of bytes."""
    rest = F.array(*[((c("splat_id") * (k + 3)) % 101 / 101 - 0.5) for k in range(9)])
    s = splats(spark, sf).withColumns({"part": c("splat_id") % 4, "sh_rest": rest})
    folder = new_dir(spark, "ply")
    stored(save(bi.ply_files(s, ["part"], ["splat_id"], 700).withColumn("name", F.format_string("part-%d-%d.ply", "part", "block")), folder), "ply-files")
    p = bi.read_ply(spark, folder, chunk=1 << 14).withColumn("part", F.regexp_extract("file", r"part-(\d+)-\d+\.ply$", 1).cast("long"))
    return p.select("part", *[r(k, 3).alias(k) for k in ("x", "y", "z", "qy", "s1")], r("dc2", 2).alias("dc2"), F.size("sh_rest").alias("higher"))


@query("s17_splat_records", S, q=f"""WITH {DEC} SELECT mod(splat_id, 4) AS part, round(x, 3) + 0e0 AS x, round(sy, 4) + 0e0 AS sy, CAST(floor(c0 + 0.5e0) AS INT) AS red, CAST(floor(op * 255 + 0.5e0) AS INT) AS alpha,
 CAST(least(255, floor(w * 128 + 128.5e0)) AS INT) AS qw, CAST(floor(k * 128 + 128.5e0) AS INT) AS qz FROM d""")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    s = splats(spark, sf).withColumn("part", c("splat_id") % 4)
    p = bi.read_splat_records(bi.splat_records(s, ["part"], ["splat_id"], 700), ["part", "block"])
    return p.select("part", r("x", 3).alias("x"), r("sy", 4).alias("sy"), "red", "alpha", "qw", "qz")


@query("s14_read_dem", "fx_aoi", "fx_bed", q="SELECT CAST(aoi_id AS BIGINT) AS aoi_id, b.row, b.col, CASE WHEN mod(b.row * b.col + aoi_id, 17) <> 3 THEN floor(z * 64) / 64e0 + aoi_id END AS z FROM fx_aoi, fx_bed b")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    """A raster a tile, some cells missing; values that a float holds exactly."""
    from geofuse.operators.bed import synthetic_bed

    b = synthetic_bed(view(spark, sf, "fx_aoi").select(c("aoi_id").cast("long").alias("aoi_id")), 96, 72)
    kept = b.filter((c("row") * c("col") + c("aoi_id")) % 17 != 3).withColumn("z", F.floor(c("z") * 64) / 64 + c("aoi_id"))
    return bi.decode_dem(bi.dem_files(kept, ["aoi_id"], 72, 96), ["aoi_id"])


OBS = "o AS (SELECT solver, image_id, point_id, err_px, row_number() OVER (PARTITION BY solver, image_id ORDER BY point_id) - 1 AS idx FROM fx_obs)"


def sparse_model(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """A model a solver, written as text to the shared folder and read back."""
    from pyspark.sql import Window

    o = view(spark, sf, "fx_obs")
    place = F.row_number().over(Window.partitionBy("solver", "image_id").orderBy("point_id")) - 1
    obs = o.select("solver", "image_id", place.alias("idx"), (c("point_id") % 640 + 0.5).alias("x"), (c("point_id") % 480 + 0.25).alias("y"), F.when(c("point_id") % 5 != 0, c("point_id")).alias("point_id"))
    v = view(spark, sf, "fx_view").select(c("image_id").alias("v_id"), "camera_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz")
    images = o.select("solver", "image_id").distinct().join(v, c("image_id") % 12 == c("v_id")).drop("v_id").withColumn("name", F.format_string("img %05d.jpg", "image_id"))
    cameras = view(spark, sf, "fx_view").select("camera_id", "f").distinct().crossJoin(o.select("solver").distinct())
    cameras = cameras.select("solver", "camera_id", F.lit("PINHOLE").alias("model"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.array("f", c("f") + 1, F.lit(320.0), F.lit(240.0)).alias("params"))
    points = o.groupBy("solver", "point_id").agg(r(F.avg("err_px")).alias("error")).withColumns({"x": c("point_id") / 8, "y": c("point_id") / 4, "z": c("point_id") / 2, "r": c("point_id") % 256, "g": c("point_id") % 7, "b": F.lit(9)})
    track = obs.filter("point_id IS NOT NULL").select("solver", "point_id", "image_id", "idx")
    folder = new_dir(spark, "model")
    md.write_sfm_text(folder, ["solver"], cameras, images, obs, points, track)
    return md.read_sfm_text(spark, folder, ["solver"])


@query("s18_model_observations", "fx_obs", "fx_view", q=f"""WITH {OBS} SELECT solver, o.image_id, printf('img %05d.jpg', o.image_id) AS name, v.camera_id, round(v.tx, 6) + 0e0 AS tx, CAST(idx AS INT) AS idx, mod(point_id, 640) + 0.5e0 AS x, mod(point_id, 480) + 0.25e0 AS y, CASE WHEN mod(point_id, 5) <> 0 THEN point_id END AS point_id
FROM o JOIN fx_view v ON v.image_id = mod(o.image_id, 12)""")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    m = sparse_model(spark, sf)
    return m["obs"].join(m["images"], ["solver", "image_id"]).select("solver", "image_id", "name", "camera_id", r("tx").alias("tx"), "idx", "x", "y", "point_id")


@query("s18_model_points", "fx_obs", "fx_view", q=f"""WITH {OBS}, e AS (SELECT solver, point_id, round(avg(err_px), 6) + 0e0 AS error FROM o GROUP BY 1, 2), t AS (SELECT solver, point_id, image_id, idx FROM o WHERE mod(point_id, 5) <> 0)
SELECT e.solver, e.point_id, point_id / 4e0 AS y, CAST(mod(point_id, 256) AS INT) AS r, error, image_id, CAST(idx AS INT) AS idx, v.f AS fx, v.f + 1 AS fy FROM e LEFT JOIN t USING (solver, point_id) LEFT JOIN fx_view v USING (image_id)""")
def s18_points(spark: SparkSession, sf: str) -> DataFrame:
    m = sparse_model(spark, sf)
    cams = md.focal_and_centre(m["cameras"]).select("solver", "camera_id", "fx", "fy")
    seen = m["points"].join(m["track"], ["solver", "point_id"], "left")
    images = m["images"].filter("image_id < 12").join(cams, ["solver", "camera_id"]).select("solver", "image_id", "fx", "fy")
    return seen.join(images, ["solver", "image_id"], "left").select("solver", "point_id", "y", "r", "error", "image_id", "idx", "fx", "fy")


@query("w8_stride_sample", "fx_evidence", q="""WITH i AS (SELECT source, x, y, z, row_number() OVER (PARTITION BY source ORDER BY x, y, z) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM fx_evidence),
k AS (SELECT *, ceil(i / greatest(n / 300e0, 1e0)) AS k FROM i) SELECT source, CAST(k AS BIGINT) AS k, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM k WHERE floor(k * greatest(n / 300e0, 1e0)) = i AND k < 300""")
def w8_stride(spark: SparkSession, sf: str) -> DataFrame:
    """300 points of each source, evenly by place: a sampling operator."""
    e = view(spark, sf, "fx_evidence").select("source", *[c(k).cast("double").alias(k) for k in "xyz"])
    return stride_sample(e, ["source"], ["x", "y", "z"], 300).select("source", c("k").cast("long").alias("k"), *[r(k).alias(k) for k in "xyz"])


@query("a4_align_cloud", S, q=f"""SELECT part, CASE part WHEN 0 THEN 1.25e0 WHEN 1 THEN 0.8e0 ELSE {round(math.exp(1.2), 6)}e0 END AS scale, 30e0 AS degrees, part <> 2 AS accepted FROM (SELECT DISTINCT mod(splat_id, 3) AS part FROM fx_splat) p""")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    """Each part against itself turned thirty degrees and scaled; the last by more than is allowed."""
    s = splats(spark, sf).select((c("splat_id") % 3).alias("part"), "splat_id", *"xyz")
    rot, by = axis_rotation((0, 0, 1), 30), F.when(c("part") == 0, 1.25).when(c("part") == 1, 0.8).otherwise(20.0)
    moved = {k: by * sum((rot[i][j] * c(a) for j, a in enumerate("xyz")), F.lit(0.0)) + (i - 1.5) for i, k in enumerate("xyz")}
    out = su.align_cloud(s, s.select("part", "splat_id", *[e.alias(k) for k, e in moved.items()]), ["part"], ["splat_id"])
    return out.select("part", r("scale").alias("scale"), r("degrees", 4).alias("degrees"), "accepted")


FIELD = "fx_field AS (SELECT s_suppkey AS site, x AS vx, y AS vy, z AS vz, round(sqrt((x - 4) * (x - 4) + (y - 4) * (y - 4) + (z - 4) * (z - 4)) - 1.3e0 - mod(s_suppkey, 17) / 10e0, 6) AS value FROM supplier, range(0, 9) a(x), range(0, 9) b(y), range(0, 9) d(z) WHERE mod(x + 3 * y + 5 * z + s_suppkey, 97) <> 0)"


def field(spark: SparkSession, sf: str) -> DataFrame:
    """A sphere in a lattice for each supplier, of its own size, with a few samples missing."""
    return sql(spark, sf, f"WITH {FIELD} SELECT * FROM fx_field")


@query("g5_iso_surface", q=f"""WITH {FIELD}, full_cube AS (SELECT site, vx - i AS cx, vy - j AS cy, vz - k AS cz FROM fx_field, range(0, 2) a(i), range(0, 2) b(j), range(0, 2) d(k) GROUP BY ALL HAVING count(*) = 8),
e AS (SELECT p.site, p.vx, p.vy, p.vz, a.axis, -p.value / (q.value - p.value) AS t FROM fx_field p CROSS JOIN range(0, 3) a(axis) JOIN fx_field q ON q.site = p.site AND q.vx = p.vx + CASE WHEN a.axis = 0 THEN 1 ELSE 0 END AND q.vy = p.vy + CASE WHEN a.axis = 1 THEN 1 ELSE 0 END AND q.vz = p.vz + CASE WHEN a.axis = 2 THEN 1 ELSE 0 END
 WHERE (p.value < 0) <> (q.value < 0))
SELECT DISTINCT e.site, e.vx, e.vy, e.vz, CAST(e.axis AS INT) AS axis, round(vx + CASE WHEN axis = 0 THEN t ELSE 0 END, 6) + 0e0 AS x, round(vy + CASE WHEN axis = 1 THEN t ELSE 0 END, 6) + 0e0 AS y, round(vz + CASE WHEN axis = 2 THEN t ELSE 0 END, 6) + 0e0 AS z
FROM e JOIN full_cube f ON f.site = e.site AND e.vx - f.cx BETWEEN 0 AND CASE WHEN axis = 0 THEN 0 ELSE 1 END AND e.vy - f.cy BETWEEN 0 AND CASE WHEN axis = 1 THEN 0 ELSE 1 END AND e.vz - f.cz BETWEEN 0 AND CASE WHEN axis = 2 THEN 0 ELSE 1 END""")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    """The vertices: every crossed edge of a cube that is observed whole."""
    v, _ = su.iso_surface(field(spark, sf), ["site"])
    return v.select("site", "vx", "vy", "vz", "axis", *[r(k).alias(k) for k in "xyz"])


#: A colour of a sample, by its place.
R = "mod(mod({0}.vx * 3 + {0}.vy * 5 + {0}.vz * 7, 11) + 11, 11) / 10e0"


@query("g5_surface_colours", q=f"""WITH {FIELD}, full_cube AS (SELECT site, vx - i AS cx, vy - j AS cy, vz - k AS cz FROM fx_field, range(0, 2) a(i), range(0, 2) b(j), range(0, 2) d(k) GROUP BY ALL HAVING count(*) = 8),
e AS (SELECT p.site, p.vx, p.vy, p.vz, a.axis, -p.value / (q.value - p.value) AS t, {R.format("p")} AS r0, {R.format("q")} AS r1 FROM fx_field p CROSS JOIN range(0, 3) a(axis) JOIN fx_field q ON q.site = p.site AND q.vx = p.vx + CASE WHEN a.axis = 0 THEN 1 ELSE 0 END AND q.vy = p.vy + CASE WHEN a.axis = 1 THEN 1 ELSE 0 END AND q.vz = p.vz + CASE WHEN a.axis = 2 THEN 1 ELSE 0 END
 WHERE (p.value < 0) <> (q.value < 0))
SELECT DISTINCT e.site, e.vx, e.vy, e.vz, CAST(e.axis AS INT) AS axis, round(vx + CASE WHEN axis = 0 THEN t ELSE 0 END, 6) + 0e0 AS x, round(vy + CASE WHEN axis = 1 THEN t ELSE 0 END, 6) + 0e0 AS y, round(vz + CASE WHEN axis = 2 THEN t ELSE 0 END, 6) + 0e0 AS z, round(r0 + t * (r1 - r0), 9) + 0e0 AS r
FROM e JOIN full_cube f ON f.site = e.site AND e.vx - f.cx BETWEEN 0 AND CASE WHEN axis = 0 THEN 0 ELSE 1 END AND e.vy - f.cy BETWEEN 0 AND CASE WHEN axis = 1 THEN 0 ELSE 1 END AND e.vz - f.cz BETWEEN 0 AND CASE WHEN axis = 2 THEN 0 ELSE 1 END""")
def g5_colours(spark: SparkSession, sf: str) -> DataFrame:
    """The vertices with a colour, carried along the edges that are cut; bricks so small that most surfaces cross many."""
    shade = F.pmod(c("vx") * 3 + c("vy") * 5 + c("vz") * 7, F.lit(11)) / 10
    v, _ = su.iso_surface(field(spark, sf).withColumn("r", shade), ["site"], colours=("r",), brick=4)
    return v.select("site", "vx", "vy", "vz", "axis", *[r(k).alias(k) for k in "xyz"], r("r", 9).alias("r"))


@query("g5_surface_area")
def g5_area(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles and area of each surface."""
    _, t = su.iso_surface(field(spark, sf), ["site"], places=True)
    a, b = [[c(f"{n}{k}") - c(f"{n}0") for n in "xyz"] for k in (1, 2)]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    inside = (c("x0") * n[0] + c("y0") * n[1] + c("z0") * n[2]) / 6
    return t.groupBy("site").agg(F.count(F.lit(1)).alias("triangles"), r(F.sum(area), 4).alias("area"), r(F.sum(inside), 4).alias("volume"))


SIG = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
COVARIANCE = COV.replace("round(", "(").replace(", 9) + 0e0 AS", ") AS")
COLUMNS = ["CASE WHEN sx <= sy AND sx <= sz THEN {} WHEN sy <= sz THEN {} ELSE {} END".format(*ROT[i]) for i in range(3)]
VIEWED = f"""{DEC}, n AS (SELECT splat_id, x, y, z, op, {COVARIANCE}, {", ".join(f"{e} AS n{k}" for e, k in zip(COLUMNS, "xyz"))} FROM d WHERE op >= 0.02e0),
v AS (SELECT *, tx AS vtx, ty AS vty, tz AS vtz, f * 0.05e0 AS vf, 32e0 AS vw, 24e0 AS vh FROM fx_view),
b AS (SELECT image_id, splat_id, op, n.x + vtx AS ax, n.y + vty AS ay, n.z + vtz AS dz, vf, vw, vh, c00, c01, c02, c11, c12, c22, nx, ny, nz, CASE WHEN nx * (-vtx - n.x) + ny * (-vty - n.y) + nz * (-vtz - n.z) < 0 THEN -1e0 ELSE 1e0 END AS flip FROM n, v WHERE n.z + vtz >= 1e-3),
j AS (SELECT *, vf / dz AS k, -vf * ax / (dz * dz) AS p, -vf * ay / (dz * dz) AS q FROM b),
e AS (SELECT *, k * k * c00 + 2 * k * p * c02 + p * p * c22 + 0.3e0 AS e0, k * k * c01 + k * q * c02 + p * k * c12 + p * q * c22 AS e1, k * k * c11 + 2 * k * q * c12 + q * q * c22 + 0.3e0 AS e2, vf * ax / dz + 16e0 AS u, vf * ay / dz + 12e0 AS w FROM j),
s AS (SELECT *, e0 * e2 - e1 * e1 AS det, 3 * sqrt((e0 + e2) / 2 + sqrt(greatest(((e0 + e2) / 2) * ((e0 + e2) / 2) - (e0 * e2 - e1 * e1), 0e0))) AS radius FROM e),
px AS (SELECT s.*, x.px, y.py, -0.5e0 * (e2 * (x.px + 0.5e0 - u) * (x.px + 0.5e0 - u) - 2 * e1 * (x.px + 0.5e0 - u) * (y.py + 0.5e0 - w) + e0 * (y.py + 0.5e0 - w) * (y.py + 0.5e0 - w)) / det AS power
 FROM s, range(0, 32) x(px), range(0, 24) y(py) WHERE det > 1e-12 AND radius <= 96 AND u + radius >= 0 AND w + radius >= 0 AND u - radius < vw AND w - radius < vh
 AND x.px BETWEEN floor((u - radius) / 16) * 16 AND floor((u + radius) / 16) * 16 + 15 AND y.py BETWEEN floor((w - radius) / 16) * 16 AND floor((w + radius) / 16) * 16 + 15 AND abs(x.px + 0.5e0 - u) <= sqrt(24 * e0) + 1 AND abs(y.py + 0.5e0 - w) <= sqrt(24 * e2) + 1),
a AS (SELECT image_id, px, py, splat_id, dz, nx * flip AS nx, ny * flip AS ny, nz * flip AS nz, least(op * exp(power), 0.99e0) AS al FROM px WHERE power <= 0 AND power >= -12 AND op * exp(power) >= 1 / 255e0),
l AS (SELECT *, exp(coalesce(sum(ln(1 - al)) OVER (PARTITION BY image_id, py, px ORDER BY dz, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS li FROM a),
o AS (SELECT image_id, px, py, sum(li * al) AS cover, sum(li * al * dz) / sum(li * al) AS depth, sum(li * al * nx) AS sx, sum(li * al * ny) AS sy, sum(li * al * nz) AS sz FROM l WHERE li >= 1e-3 GROUP BY ALL)"""


@query("a29_composite_depth", S, "fx_view", q=f"WITH {VIEWED} SELECT image_id, py, px, round(depth, 3) AS depth, round(cover, 3) AS cover, round(sz / sqrt(sx * sx + sy * sy + sz * sz), 2) + 0e0 AS nz FROM o WHERE cover >= 0.62e0")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    """Small images of every view."""
    d = su.composite_depth(splats(spark, sf), view(spark, sf, "fx_view"), 32)
    return d.select("image_id", "py", "px", r("depth", 3).alias("depth"), r("cover", 3).alias("cover"), r("nz", 2).alias("nz"))


SOURCES = ("colmap", "fixer", "gof", "vggt-commercial", "other")
NAMES = ("3DEP", "Copernicus DEM", "opentopo", "NWIS", "Overture / OSM", "my file")


@query("p12_license_alias", q=f"""SELECT p_partkey AS k, CASE mod(p_partkey, 5) WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'NVIDIA-OML' WHEN 2 THEN 'NC-research' WHEN 3 THEN 'commercial' ELSE 'unknown' END AS license,
 CASE mod(p_partkey, 6) WHEN 0 THEN 'usgs-3dep' WHEN 1 THEN 'copernicus-glo30' WHEN 2 THEN 'opentopography' WHEN 3 THEN 'usgs-nwis-gauges' WHEN 4 THEN 'osm-waterways' ELSE 'my-file' END AS id FROM part""")
def p12_license(spark: SparkSession, sf: str) -> DataFrame:
    p = sql(spark, sf, "SELECT p_partkey AS k FROM part")
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), (c("k") % len(names)).cast("int"))
    return p.select("k", cat.license_for(pick(SOURCES)).alias("license"), cat.resolve_alias(pick(NAMES)).alias("id"))


@query("s21_list_cached", q="""SELECT p_partkey AS k, CASE mod(p_partkey, 6) WHEN 0 THEN 'geotiff' WHEN 1 THEN 'geojson' ELSE 'cog' END AS format FROM part WHERE mod(p_partkey, 6) < 3""")
def s21_cached(spark: SparkSession, sf: str) -> DataFrame:
    p = sql(spark, sf, "SELECT p_partkey AS k FROM part")
    ends = F.array(*[F.lit(e) for e in (".TIF", ".json", ".cog", ".meta.json", ".catalog.json", ".las")])
    files = p.withColumn("path", F.concat(F.lit("geo/sources/a."), c("k"), F.get(ends, (c("k") % 6).cast("int"))))
    return cat.list_cached(files).select("k", "format")


@query("w9_lerp_clouds", S, q="SELECT splat_id, round(x + 0.25e0 * (2 * x + 1 - x), 6) + 0e0 AS x, round(s0 + 0.25e0 * 0.5e0, 6) + 0e0 AS s0 FROM fx_splat WHERE mod(splat_id, 7) <> 0")
def w9_clouds(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the way to a state that lacks every seventh splat."""
    a = splats(spark, sf)
    b = a.filter("mod(splat_id, 7) <> 0").withColumns({"x": 2 * c("x") + 1, "s0": c("s0") + 0.5})
    return cl.lerp_clouds(a, b, ["splat_id"], 0.25).select("splat_id", r("x").alias("x"), r("s0").alias("s0"))


@query("j13_nearest_refs", "fx_pixel", q="""WITH i AS (SELECT capture, image_id, row_number() OVER (PARTITION BY capture ORDER BY image_id) AS i FROM (SELECT DISTINCT image_id, mod(image_id, 5) AS capture FROM fx_pixel) d),
n AS (SELECT a.capture, a.image_id, b.image_id AS ref, row_number() OVER (PARTITION BY a.capture, a.image_id ORDER BY abs(a.i - b.i), b.i) AS k FROM i a JOIN i b ON a.capture = b.capture AND a.image_id <> b.image_id WHERE mod(b.image_id, 3) = 1) SELECT * FROM n WHERE k <= 3""")
def j13_refs(spark: SparkSession, sf: str) -> DataFrame:
    i = view(spark, sf, "fx_pixel").select("image_id").distinct().withColumn("capture", c("image_id") % 5)
    return sfm.nearest_refs(i, i.filter("mod(image_id, 3) = 1")).select("capture", "image_id", "ref", "k")

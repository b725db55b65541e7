"""Point clouds and splats."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import view
from geofuse.functions import camera as cam
from geofuse.functions import splat as sp
from geofuse.operators import cloud as op
from geofuse.plans.shared import few
from geofuse.queries.registry import query, r

c = F.col
S = "fx_splat"


def splats(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, S)
    return s.select(*[c(k) if k == "splat_id" else c(k).cast("double").alias(k) for k in s.columns])


NQ = "sqrt(qw * qw + qx * qx + qy * qy + qz * qz)"
DEC = f"d AS (SELECT *, exp(s0) AS sx, exp(s1) AS sy, exp(s2) AS sz, 1e0 / (1e0 + exp(-opacity_logit)) AS op, qw / {NQ} AS w, qx / {NQ} AS i, qy / {NQ} AS j, qz / {NQ} AS k, " + ", ".join(
    f"greatest(0e0, least(255e0, (0.5e0 + 0.28209479177387814e0 * dc{n}) * 255e0)) AS c{n}" for n in range(3)
) + " FROM fx_splat)"


@query("p13_splat_decode", S, q=f"WITH {DEC} SELECT splat_id, round(sx, 6) AS sx, round(op, 6) AS opacity, round(w, 6) AS uw, round(k, 6) AS uz, round(c0, 4) AS red, round(c2, 4) AS blue FROM d")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    d = op.decode(splats(spark, sf))
    return d.select("splat_id", r("sx").alias("sx"), r("opacity").alias("opacity"), r("uw").alias("uw"), r("uz").alias("uz"), r("red", 4).alias("red"), r("blue", 4).alias("blue"))


ROT = [["1 - 2 * (j * j + k * k)", "2 * (i * j - w * k)", "2 * (i * k + w * j)"], ["2 * (i * j + w * k)", "1 - 2 * (i * i + k * k)", "2 * (j * k - w * i)"], ["2 * (i * k - w * j)", "2 * (j * k + w * i)", "1 - 2 * (i * i + j * j)"]]
COV = ", ".join("round(" + " + ".join(f"({ROT[a][n]}) * ({ROT[b][n]}) * s{'xyz'[n]} * s{'xyz'[n]}" for n in range(3)) + f", 9) + 0e0 AS c{a}{b}" for a in range(3) for b in range(a, 3))


@query("p14_splat_covariance", S, q=f"WITH {DEC} SELECT splat_id, {COV} FROM d")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    d = op.covariance(splats(spark, sf))
    return d.select("splat_id", *[r(f"c{a}{b}", 9).alias(f"c{a}{b}") for a in range(3) for b in range(a, 3)])


@query("p15_transform_cloud", S, q="""SELECT splat_id, round((0.8660254037844387e0 * (x - 1) * 2 - 0.5e0 * (y - 2) * 2) + 1 + 10, 6) + 0e0 AS x, round((0.5e0 * (x - 1) * 2 + 0.8660254037844387e0 * (y - 2) * 2) + 2 + 20, 6) + 0e0 AS y, round((z - 3) * 2 + 3 - 5, 6) + 0e0 AS z,
 round(0.9659258262890683e0 * qw - 0.25881904510252074e0 * qz, 6) + 0e0 AS qw, round(0.9659258262890683e0 * qz + 0.25881904510252074e0 * qw, 6) + 0e0 AS qz, round(s0 + ln(2e0), 6) + 0e0 AS s0 FROM fx_splat""")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty degrees about up, twice the size."""
    half = math.radians(15)
    t = op.transform(splats(spark, sf), sp.axis_rotation((0, 0, 1), 30), (math.cos(half), 0.0, 0.0, math.sin(half)), 2.0, (1.0, 2.0, 3.0), (10.0, 20.0, -5.0))
    return t.select("splat_id", *[r(k).alias(k) for k in ("x", "y", "z", "qw", "qz", "s0")])


@query("p18_quantize_splats", S, q=f"""WITH {DEC} SELECT splat_id, CAST(floor(x * 4096 + 0.5e0) AS INT) & 16777215 AS px, CAST(floor(y * 4096 + 0.5e0) AS INT) & 16777215 AS py, CAST(floor(z * 4096 + 0.5e0) AS INT) & 16777215 AS pz,
 CAST(floor(op * 255 + 0.5e0) AS INT) AS alpha, CAST(greatest(0, least(255, floor(dc0 * 38.25e0 + 127.5e0 + 0.5e0))) AS INT) AS c0, CAST(floor((s0 + 10) * 16 + 0.5e0) AS INT) AS l0,
 CAST(0 AS INT) AS largest, CAST(floor(i * 722.6631303726517e0 + 0.5e0) AS INT) AS qa, CAST(floor(k * 722.6631303726517e0 + 0.5e0) AS INT) AS qc FROM d""")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    """w is the largest part of every quaternion in this view, and its signs are positive."""
    return op.quantize(splats(spark, sf)).select("splat_id", "px", "py", "pz", "alpha", "c0", "l0", "largest", "qa", "qc")


E = "fx_evidence"


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, E)
    return e.select("source", *[c(k).cast("double").alias(k) for k in ("x", "y", "z", "r", "g", "b", "confidence")], "preserve")


@query("a5_cloud_stats", E, q="""WITH m AS (SELECT source, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM fx_evidence GROUP BY source)
SELECT source, round(mx, 6) AS mx, round(my, 6) AS my, round(sqrt(avg((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))), 6) AS rms, round(min(x), 6) AS min_x, round(max(z), 6) AS max_z, count(*) AS n FROM fx_evidence JOIN m USING (source) GROUP BY source, mx, my, mz""")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    s = op.cloud_stats(evidence(spark, sf), ["source"])
    return s.select("source", r("mx").alias("mx"), r("my").alias("my"), r("rms").alias("rms"), r("min_x").alias("min_x"), r("max_z").alias("max_z"), "n")


@query("a6_robust_radius", E, q="""WITH m AS (SELECT source, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM fx_evidence GROUP BY source),
d AS (SELECT source, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS d FROM fx_evidence JOIN m USING (source)),
k AS (SELECT source, d, row_number() OVER (PARTITION BY source ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d) SELECT source, round(d, 6) AS radius FROM k WHERE i = floor((n - 1) * 0.9e0)""")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return op.robust_radius(evidence(spark, sf), ["source"], 0.9).select("source", r("radius").alias("radius"))


FUSED = """f AS (SELECT floor(x / 0.05e0) AS vx, floor(y / 0.05e0) AS vy, floor(z / 0.05e0) AS vz, sum(x * confidence) / sum(confidence) AS x, sum(y * confidence) / sum(confidence) AS y, sum(z * confidence) / sum(confidence) AS z,
 sum(r * confidence) / sum(confidence) AS r, sum(confidence) AS weight FROM fx_evidence WHERE confidence >= 0.15e0 AND NOT (preserve AND confidence >= 0.7e0) GROUP BY 1, 2, 3)"""


@query("a7_fuse_voxels", E, q=f"WITH {FUSED} SELECT CAST(vx AS BIGINT) AS vx, CAST(vy AS BIGINT) AS vy, CAST(vz AS BIGINT) AS vz, round(x + 1e-9, 6) + 0e0 AS x, round(y + 1e-9, 6) + 0e0 AS y, round(z + 1e-9, 6) + 0e0 AS z, round(weight, 6) AS weight FROM f")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    """1e-9 keeps means that end in 5 from being rounded either way."""
    v = op.fuse_voxels(evidence(spark, sf), 20.0)
    return v.select("vx", "vy", "vz", *[r(c(k) + 1e-9).alias(k) for k in "xyz"], r("weight").alias("weight"))


@query("a7_fuse_evidence", E, q=f"""WITH {FUSED}, p AS (SELECT count(*) AS n FROM fx_evidence WHERE preserve AND confidence >= 0.7e0), s AS (SELECT (SELECT count(*) FROM f) AS n_f, n AS n_p, 1000 - least(n, 200) AS budget FROM p)
SELECT 'fused' AS kind, CAST(least(n_f, budget) AS BIGINT) AS n FROM s UNION ALL SELECT 'preserved', CAST(least(n_p, 1000 - least(n_f, budget)) AS BIGINT) FROM s""")
def a7_budget(spark: SparkSession, sf: str) -> DataFrame:
    return op.fuse_evidence(evidence(spark, sf), 20.0, 1000).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("o1_top_by_weight", E, q=f"WITH {FUSED} SELECT round(weight, 6) AS weight FROM f ORDER BY f.weight DESC LIMIT 500")
def o1(spark: SparkSession, sf: str) -> DataFrame:
    """The 500 heaviest voxels: a top-k report."""
    return op.fuse_voxels(evidence(spark, sf), 20.0).orderBy(c("weight").desc()).limit(500).select(r("weight").alias("weight"))


PAL = ", ".join(f"({i}, '{n}', {x}, {y}, {z})" for i, (n, x, y, z) in enumerate(op.PALETTE))


@query("j6_nearest_palette", E, q=f"""SELECT r, g, b, block FROM (SELECT e.*, p.block, row_number() OVER (PARTITION BY r, g, b ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), i) AS k
FROM (SELECT DISTINCT CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM fx_evidence) e, (VALUES {PAL}) p(i, block, pr, pg, pb)) z WHERE k = 1""")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence(spark, sf).select(*[c(k).cast("int").alias(k) for k in "rgb"]).distinct()
    return e.withColumn("block", op.nearest_palette(c("r"), c("g"), c("b")))


@query("a8_voxelize_splats")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return op.voxelize(splats(spark, sf), 32)


def views(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_view")


SEEN = """seen AS (SELECT splat_id, image_id, f / depth AS nu FROM (SELECT s.splat_id, v.image_id, v.f, v.width, v.height, s.x + v.tx AS cx, s.y + v.ty AS cy, s.z + v.tz AS depth FROM fx_splat s, fx_view v) p
 WHERE depth > 1e-4 AND f * cx / depth + width / 2 BETWEEN -0.1e0 * width AND 1.1e0 * width AND f * cy / depth + height / 2 BETWEEN -0.1e0 * height AND 1.1e0 * height)"""


@query("j8_splats_in_views", S, "fx_view", q=f"WITH {SEEN} SELECT splat_id, image_id, round(nu, 4) AS nu FROM seen")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    s = op.in_views(splats(spark, sf).select("splat_id", *"xyz"), views(spark, sf))
    return s.select("splat_id", "image_id", r(c("f") / c("depth"), 4).alias("nu"))


@query("a9_mip_filter", S, "fx_view", q=f"""WITH {SEEN}, m AS (SELECT splat_id, max(nu) AS nu FROM seen GROUP BY 1), d AS (SELECT s.*, nu, (0.2e0 / nu) * (0.2e0 / nu) AS v, 1e0 / (1e0 + exp(-opacity_logit)) AS a FROM fx_splat s LEFT JOIN m USING (splat_id))
SELECT splat_id, nu IS NOT NULL AS filtered, round(CASE WHEN nu IS NULL THEN s0 ELSE 0.5e0 * ln(exp(2 * s0) + v) END, 6) + 0e0 AS s0,
 round(CASE WHEN nu IS NULL THEN a ELSE a * sqrt(exp(2 * s0) / (exp(2 * s0) + v) * (exp(2 * s1) / (exp(2 * s1) + v)) * (exp(2 * s2) / (exp(2 * s2) + v))) END, 6) AS opacity FROM d""")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    m = op.mip_filter(splats(spark, sf), views(spark, sf))
    return m.select("splat_id", "filtered", r("s0").alias("s0"), r("opacity").alias("opacity"))


@query("p28_evidence_filter", E, q="SELECT source, count(*) AS n FROM fx_evidence WHERE confidence >= 0.15e0 GROUP BY source")
def p28(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).filter(c("confidence") >= 0.15).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("p29_points_to_splats", E, q="""SELECT source, x, y, z, round(ln(least(0.05e0, greatest(1e-4, 20e0 / cbrt((SELECT count(*) FROM fx_evidence))))), 6) AS s0, round((r / 255e0 - 0.5e0) / 0.28209479177387814e0, 6) + 0e0 AS dc0 FROM (SELECT source, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) + 0e0 AS z, r FROM fx_evidence) e""")
def p29(spark: SparkSession, sf: str) -> DataFrame:
    p = op.points_to_splats(evidence(spark, sf), 20.0)
    return p.select("source", r("x").alias("x"), r("y").alias("y"), r("z").alias("z"), r("s0").alias("s0"), r("dc0").alias("dc0"))


@query("p19_project", E, "fx_view", q="""SELECT source, image_id, count(*) AS ahead, round(sum(f * cx / cz + 320e0), 1) AS su FROM (SELECT e.source, v.image_id, v.f, e.x + v.tx AS cx, e.z + v.tz AS cz FROM fx_evidence e, fx_view v) p WHERE cz > 1e-6 GROUP BY ALL""")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    both = evidence(spark, sf).join(few(views(spark, sf), what="views"))
    p = cam.world_to_cam((c("qw"), c("qx"), c("qy"), c("qz")), (c("tx"), c("ty"), c("tz")), (c("x"), c("y"), c("z")))
    both = both.withColumns({"cx": p[0], "cy": p[1], "cz": p[2]})
    u, _ = cam.project([c("cx"), c("cy"), c("cz")], c("f"), c("width"), c("height"))
    return both.withColumn("u", u).filter("u IS NOT NULL").groupBy("source", "image_id").agg(F.count(F.lit(1)).alias("ahead"), r(F.sum("u"), 1).alias("su"))


@query("m4_backproject", "fx_pixel", "fx_view", q="""SELECT p.image_id, p.y, p.x, round((p.x - 4) / 8e0 * z + 0.8e0 * v.image_id, 6) + 0e0 AS wx, round((p.y - 4) / 8e0 * z + 2.5e0, 6) + 0e0 AS wy, round(z - v.tz, 6) + 0e0 AS wz
FROM (SELECT *, 1e0 + g / 50e0 AS z FROM fx_pixel WHERE mod(x, 2) = 0 AND mod(y, 2) = 0) p JOIN fx_view v ON v.image_id = mod(p.image_id, 12) WHERE z > 1e-4""")
def m4(spark: SparkSession, sf: str) -> DataFrame:
    """Every second pixel of a depth image back in the world: expressions alone."""
    px = view(spark, sf, "fx_pixel").filter("mod(x, 2) = 0 AND mod(y, 2) = 0").withColumn("z", 1 + c("g") / 50).filter("z > 1e-4")
    v = views(spark, sf).select(c("image_id").alias("v_id"), "qw", "qx", "qy", "qz", "tx", "ty", "tz")
    px = px.join(few(v, what="views"), c("image_id") % 12 == c("v_id"))
    d = [(c("x") - 4) / 8 * c("z") - c("tx"), (c("y") - 4) / 8 * c("z") - c("ty"), c("z") - c("tz")]
    m = sp.rotation(c("qw"), c("qx"), c("qy"), c("qz"))
    w = [m[0][i] * d[0] + m[1][i] * d[1] + m[2][i] * d[2] for i in range(3)]
    return px.select("image_id", "y", "x", *[r(e).alias(n) for e, n in zip(w, ("wx", "wy", "wz"))])

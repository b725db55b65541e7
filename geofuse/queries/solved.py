"""Solves whose answer is known in closed form: the input is made from it, SQL states it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import view
from geofuse.functions.harmonics import rotate_sh
from geofuse.functions.splat import axis_rotation
from geofuse.operators import cloud as cl
from geofuse.operators import solve as so
from geofuse.operators import telemetry as tm
from geofuse.queries.cloud import DEC, PAL, splats
from geofuse.queries.more import _pairs
from geofuse.queries.registry import query, r

c = F.col
ROT = axis_rotation((1, 2, 3), 50)
GCP = "fx_gcp"
#: How far a control point is moved along x: a few centimetres, and every 29th four metres.
MOVED = "(mod(gcp_id, 9) * 0.03e0 + mod(gcp_id, 9) * mod(gcp_id, 9) * 0.001e0 + CASE WHEN mod(gcp_id, 29) = 7 THEN 4e0 ELSE 0e0 END)"


def _planted(spark: SparkSession, sf: str) -> DataFrame:
    """Control points turned by ROT, scaled by 1.5 and the group's number, and shifted."""
    g = view(spark, sf, GCP).select("group_id", "gcp_id", *[c(k).cast("double").alias(k) for k in ("lx", "ly", "lz")])
    scale, p = 1.5 + c("group_id"), [c(k) for k in ("lx", "ly", "lz")]
    return g.withColumns({q: scale * sum((ROT[i][j] * p[j] for j in range(3)), F.lit(0.0)) + t for i, (q, t) in enumerate((("qx", 12.0), ("qy", -7.0), ("qz", 3.0)))})


@query("a2_fit_known", GCP, q=f"""SELECT group_id, count(*) AS n, 1.5e0 + group_id AS scale, {", ".join(f"{round(ROT[i][j], 6)}e0 AS r{i}{j}" for i in range(3) for j in range(3))}, 12e0 AS tx, -7e0 AS ty, 3e0 AS tz FROM fx_gcp GROUP BY group_id""")
def a2_known(spark: SparkSession, sf: str) -> DataFrame:
    """The similarity that made the points comes back."""
    f = tm.fit_sim3(_planted(spark, sf), ["group_id"])
    return f.select("group_id", "n", *[r(k).alias(k) for k in ("scale", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz")])


@query("a3_residuals_known", GCP, q=f"""WITH p AS (SELECT group_id, gcp_id, {MOVED} AS d FROM fx_gcp), s AS (SELECT group_id, avg(d) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC) AS median, count(*) AS n FROM p GROUP BY group_id)
SELECT group_id, gcp_id, round(d, 6) + 0e0 AS residual, d > greatest(3 * median, 0.15e0, 2.5e0 * mean) AS outlier FROM p JOIN s USING (group_id) WHERE n >= 3""")
def a3_known(spark: SparkSession, sf: str) -> DataFrame:
    """Points moved off the similarity by known distances: those are the residuals."""
    g = _planted(spark, sf)
    points, _ = tm.gcp_residuals(g.withColumn("qx", c("qx") + F.expr(MOVED)), tm.fit_sim3(g, ["group_id"]), ["group_id"])
    return points.select("group_id", "gcp_id", r("residual").alias("residual"), "outlier")


def _rest(k: int) -> str:
    return f"(mod(splat_id * {k + 3}, 101) / 101e0 - 0.5e0)"


def _turned(channel: int) -> list[str]:
    """A channel's first band as SQL: its coefficients are a vector (-c2, -c0, c1), which turns as directions do."""
    a, b, d = (_rest(3 * channel + k) for k in range(3))
    v = [f"(-{d})", f"(-{a})", b]
    x, y, z = (" + ".join(f"({ROT[i][j]!r}e0) * {v[j]}" for j in range(3)) for i in range(3))
    return [f"-({y})", z, f"-({x})"]


@query("p16_first_band", "fx_splat", q="SELECT splat_id, " + ", ".join(f"round({e}, 6) + 0e0 AS t{3 * ch + k}" for ch in range(3) for k, e in enumerate(_turned(ch))) + " FROM fx_splat")
def p16_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first band of three channels, turned by ROT."""
    s = splats(spark, sf).select("splat_id", F.array(*[F.expr(_rest(k)) for k in range(9)]).alias("rest"))
    t = s.withColumn("t", rotate_sh(c("rest"), 3, ROT))
    return t.select("splat_id", *[r(c("t")[k]).alias(f"t{k}") for k in range(9)])


#: What half a turn about z does to each of the fifteen functions: x and y change their signs.
HALF = (-1, 1, -1, 1, -1, 1, -1, 1, -1, 1, -1, 1, -1, 1, -1)


@query("p16_half_turn", "fx_splat", q="SELECT splat_id, " + ", ".join(f"round({HALF[k % 15]} * {_rest(k)}, 6) + 0e0 AS t{k}" for k in range(15, 30)) + " FROM fx_splat")
def p16_half(spark: SparkSession, sf: str) -> DataFrame:
    """All bands of the second channel, half a turn about z."""
    s = splats(spark, sf).select("splat_id", F.array(*[F.expr(_rest(k)) for k in range(45)]).alias("rest"))
    t = s.withColumn("t", rotate_sh(c("rest"), 15, axis_rotation((0, 0, 1), 180)))
    return t.select("splat_id", *[r(c("t")[k]).alias(f"t{k}") for k in range(15, 30)])


BALL = """d0 AS (SELECT *, (x - avg(x) OVER ()) * (x - avg(x) OVER ()) + (y - avg(y) OVER ()) * (y - avg(y) OVER ()) + (z - avg(z) OVER ()) * (z - avg(z) OVER ()) AS d2 FROM d),
rk AS (SELECT d2, row_number() OVER (ORDER BY d2) - 1 AS i, count(*) OVER () AS n FROM d0), ball AS (SELECT greatest(sqrt(d2), 1e-4) AS radius, greatest(2 * greatest(sqrt(d2), 1e-4), 1e-3) / 32 AS block FROM rk WHERE i = floor((n - 1) * 0.95e0))"""


@query("a8_voxels", "fx_splat", q=f"""WITH {DEC}, {BALL}, k AS (SELECT d0.*, block FROM d0, ball WHERE op >= 0.1e0 AND d2 <= (1.05e0 * radius) * (1.05e0 * radius)),
b AS (SELECT min(x) - any_value(block) / 2 AS lx, min(y) - any_value(block) / 2 AS ly, min(z) - any_value(block) / 2 AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM k),
z AS (SELECT b.*, greatest(1, ceil(greatest(hx + block / 2 - lx, block) / block)) AS nx, greatest(1, ceil(greatest(hy + block / 2 - ly, block) / block)) AS ny, greatest(1, ceil(greatest(hz + block / 2 - lz, block) / block)) AS nz FROM b, ball),
s AS (SELECT floor((x - lx) / block) + ox AS bx, floor((y - ly) / block) + oy AS by_, floor((z - lz) / block) + oz AS bz, greatest(op, 0.05e0) / (1 + ox * ox + oy * oy + oz * oz) AS w, c0, c1, c2, nx, ny, nz
 FROM k, z, range(-2, 3) q1(ox), range(-2, 3) q2(oy), range(-2, 3) q3(oz) WHERE greatest(abs(ox), abs(oy), abs(oz)) <= least(2, ceil((sx + sy + sz) / 3 / block))),
v AS (SELECT bx, by_, bz, sum(w) AS weight, sum(c0 * w) / sum(w) AS r, sum(c1 * w) / sum(w) AS g, sum(c2 * w) / sum(w) AS b FROM s WHERE bx >= 0 AND bx < nx AND by_ >= 0 AND by_ < ny AND bz >= 0 AND bz < nz GROUP BY bx, by_, bz HAVING sum(w) >= 1e-4)
SELECT CAST(bx AS BIGINT) AS bx, CAST(by_ AS BIGINT) AS by_, CAST(bz AS BIGINT) AS bz, round(weight, 6) AS weight, block FROM (SELECT v.*, p.block, row_number() OVER (PARTITION BY bx, by_, bz ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), i) AS q FROM v, (VALUES {PAL}) p(i, block, pr, pg, pb)) o WHERE q = 1""")
def a8_voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with their weights and colours."""
    v = cl.voxelize(splats(spark, sf), 32)
    return v.select("bx", c("by").alias("by_"), "bz", r("weight").alias("weight"), "block")


N = [round(v / math.sqrt(0.1**2 + 0.05**2 + 1), 5) for v in (-0.1, 0.05, 1)]


@query("a28_plane_known", "fx_evidence", q=f"SELECT {N[0]}e0 AS nx, {N[1]}e0 AS ny, {N[2]}e0 AS nz, round(count(*) FILTER (WHERE mod(r, 5) <> 0) * 1e0 / count(*), 6) AS share FROM fx_evidence")
def a28_known(spark: SparkSession, sf: str) -> DataFrame:
    """Points pressed to a tilted floor, those of every fifth red half a unit or more above it."""
    e = view(spark, sf, "fx_evidence").select(*[c(k).cast("double").alias(k) for k in ("x", "y", "r", "g", "b")])
    z = 0.1 * c("x") - 0.05 * c("y") + F.when(c("r") % 5 == 0, 0.5 + c("r") / 100).otherwise(0.0)
    p = so.ground_plane(e.withColumn("z", z).withColumn("key", F.struct("x", "y", "r", "g", "b")), "key")
    return p.select(*[r(k, 5).alias(k) for k in ("nx", "ny", "nz")], r("share").alias("share"))


@query("m1_essential_known", "fx_splat", q="""WITH p AS (SELECT mod(splat_id, 11) AS fa, count(*) AS n, any_value(mod(mod(splat_id, 11) + 1, 3) - mod(mod(splat_id, 11), 3)) AS dz FROM fx_splat GROUP BY 1), e AS (SELECT *, sqrt(2 * (0.64e0 + dz * dz)) AS size FROM p)
SELECT fa, fa + 1 AS fb, n AS matches, n AS inliers, round(abs(dz) / size, 4) AS e01, round(abs(dz) / size, 4) AS e10, round(0.8e0 / size, 4) AS e12, round(0.8e0 / size, 4) AS e21, 0e0 AS e00, 0e0 AS e11, 0e0 AS e22, 0e0 AS e02, 0e0 AS e20, dz < 0 AS along FROM e""")
def m1_known(spark: SparkSession, sf: str) -> DataFrame:
    """Exact matches of cameras that are shifted and not turned: the essential matrix is that of the shift, up to its sign."""
    m, _ = _pairs(spark, sf)
    v = so.two_view_verify(m, 800.0)
    return v.select("fa", "fb", "matches", "inliers", *[r(F.abs(k), 4).alias(k) for k in so.NAMES], (c("e10") * c("e21") > 0).alias("along"))


@query("m3_dense_known", "fx_splat", q="""WITH p AS (SELECT splat_id, x, y, z, mod(splat_id, 11) AS fa, 0.8e0 * mod(splat_id, 11) AS ax, 0.8e0 * (mod(splat_id, 11) + 1) AS bx, -(4e0 + mod(mod(splat_id, 11), 3)) AS az, -(4e0 + mod(mod(splat_id, 11) + 1, 3)) AS bz FROM fx_splat WHERE mod(splat_id, 3) <> 0),
v AS (SELECT *, x - ax AS ux, y - 2.5e0 AS uy, z - az AS uz, x - bx AS wx, y - 2.5e0 AS wy, z - bz AS wz FROM p),
k AS (SELECT *, degrees(acos(least(1e0, (ux * wx + uy * wy + uz * wz) / (sqrt(ux * ux + uy * uy + uz * uz) * sqrt(wx * wx + wy * wy + wz * wz))))) AS angle FROM v)
SELECT splat_id AS pair_id, fa, fa + 1 AS fb, round(x, 4) + 0e0 AS wx, round(y, 4) + 0e0 AS wy, round(z, 4) + 0e0 AS wz FROM (SELECT *, count(*) OVER (PARTITION BY fa) AS n FROM k WHERE angle >= 1e0 AND angle <= 35e0) o WHERE n >= 32""")
def m3_known(spark: SparkSession, sf: str) -> DataFrame:
    """Exact matches, a third of them uncertain: the rest come back as points where the rays are apart enough."""
    m, poses = _pairs(spark, sf)
    d = so.densify_matches(m.withColumn("certainty", F.when(c("pair_id") % 3 == 0, 0.4).otherwise(0.9)), poses, 800.0)
    return d.select("pair_id", "fa", "fb", *[r(k, 4).alias(k) for k in ("wx", "wy", "wz")])

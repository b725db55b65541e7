"""Floods: statistics, products, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import sql, view
from geofuse.functions import flood as f
from geofuse.operators import flood as op
from geofuse.plans.shared import few
from geofuse.queries.registry import query, r

c = F.col
TS = "fx_depth_ts"
STATS = """stats AS (SELECT run_id, t_s, count(*) FILTER (WHERE h > 5e-4) AS wet_cells, coalesce(max(h) FILTER (WHERE h > 5e-4), 0e0) AS max_depth, coalesce(avg(h) FILTER (WHERE h > 5e-4), 0e0) AS mean_depth,
 coalesce(sum(h * 100e0) FILTER (WHERE h > 5e-4), 0e0) AS mass, coalesce(max(sqrt(u * u + v * v)) FILTER (WHERE h > 5e-4), 0e0) AS max_speed, count(*) FILTER (WHERE h > 5e-4) * 1e0 / count(*) AS wet_fraction FROM fx_depth_ts GROUP BY run_id, t_s)"""
HAZARD = "CASE WHEN max_depth * greatest(1e0, max_speed) >= 1.8e0 OR max_depth >= 1.6e0 THEN 3 WHEN max_depth * greatest(1e0, max_speed) >= 0.9e0 OR max_depth >= 1e0 THEN 2 WHEN max_depth * greatest(1e0, max_speed) >= 0.25e0 OR max_depth >= 0.35e0 THEN 1 ELSE 0 END"


def ts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, TS)


@query("a10_depth_stats", TS, q=f"WITH {STATS} SELECT run_id, t_s, wet_cells, round(max_depth, 6) AS max_depth, round(mean_depth, 6) AS mean_depth, round(mass, 6) AS mass, round(max_speed, 6) AS max_speed, round(wet_fraction, 6) AS wet_fraction, {HAZARD} AS hazard FROM stats")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    s = op.depth_stats(ts(spark, sf))
    return s.select("run_id", "t_s", "wet_cells", r("max_depth").alias("max_depth"), r("mean_depth").alias("mean_depth"), r("mass").alias("mass"), r("max_speed").alias("max_speed"), r("wet_fraction").alias("wet_fraction"), "hazard")


@query("a10_depth_rollup", TS, q="SELECT run_id, t_s, count(*) AS cells, round(max(h), 6) AS max_depth FROM fx_depth_ts GROUP BY ROLLUP (run_id, t_s)")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ts(spark, sf).rollup("run_id", "t_s").agg(F.count(F.lit(1)).alias("cells"), r(F.max("h")).alias("max_depth"))


PAIRS = "p AS (SELECT a.run_id AS ra, b.run_id AS rb, a.t_s, a.mass, a.max_depth, a.wet_fraction, b.mass AS cm, b.max_depth AS cd, b.wet_fraction AS cw FROM stats a JOIN stats b ON a.t_s = b.t_s AND a.run_id < b.run_id)"


@query("a11_compare_checkpoint", TS, q=f"""WITH {STATS}, {PAIRS}, e AS (SELECT *, CASE WHEN cm > 1e-3 THEN abs(mass - cm) / cm WHEN mass < 1e-3 THEN 0e0 ELSE 1e0 END AS mr, abs(max_depth - cd) AS dd, abs(wet_fraction - cw) AS dw FROM p),
j AS (SELECT a.run_id AS ra, b.run_id AS rb, coalesce(a.t_s, b.t_s) AS t_s, a.h AS ha, b.h AS hb FROM fx_depth_ts a JOIN fx_depth_ts b ON a.t_s = b.t_s AND a.row = b.row AND a.col = b.col AND a.run_id < b.run_id),
k AS (SELECT ra, rb, t_s, count(*) AS n, sqrt(avg((ha - hb) * (ha - hb))) AS rmse, CASE WHEN count(*) FILTER (WHERE ha > 5e-4 OR hb > 5e-4) > 0 THEN count(*) FILTER (WHERE ha > 5e-4 AND hb > 5e-4) * 1e0 / count(*) FILTER (WHERE ha > 5e-4 OR hb > 5e-4) ELSE 1e0 END AS iou FROM j GROUP BY ALL),
n AS (SELECT run_id, t_s, count(*) AS n FROM fx_depth_ts GROUP BY ALL)
SELECT ra, rb, t_s, round(mr, 6) AS mass_rel, round(dd, 6) AS d_depth, round(dw, 6) AS d_wet, CASE WHEN k.n = x.n AND k.n = y.n THEN round(rmse, 6) END AS rmse, CASE WHEN k.n = x.n AND k.n = y.n THEN round(iou, 6) END AS iou,
 mr <= 0.15e0 AND dd <= 0.35e0 AND dw <= 0.12e0 AND coalesce(CASE WHEN k.n = x.n AND k.n = y.n THEN rmse END <= 0.4e0, true) AND coalesce(CASE WHEN k.n = x.n AND k.n = y.n THEN iou END >= 0.7e0, true) AS within
FROM e JOIN k USING (ra, rb, t_s) JOIN n x ON x.run_id = ra AND x.t_s = e.t_s JOIN n y ON y.run_id = rb AND y.t_s = e.t_s""")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    """Every run against every later one as its checkpoint, time by time."""
    t = ts(spark, sf)
    s = op.depth_stats(t)
    runs = t.select("run_id").distinct()  # pairs are of runs, not of cells, and counted
    pairs = runs.select(c("run_id").alias("ra")).join(runs.select(c("run_id").alias("rb")), c("ra") < c("rb"))
    pairs = few(pairs, what="pairs of runs")
    left, right = (t.select(c("run_id").alias(k), "t_s", "row", "col", "h") for k in ("ra", "rb"))
    cells = op.compare_cells(left.join(pairs, "ra"), right.join(pairs, "rb"), ["ra", "rb", "t_s"])
    a = s.select(c("run_id").alias("ra"), "t_s", "mass", "max_depth", "wet_fraction")
    b = s.select(c("run_id").alias("rb"), "t_s", c("mass").alias("ck_mass"), c("max_depth").alias("ck_max_depth"), c("wet_fraction").alias("ck_wet_fraction"))
    out = op.compare_checkpoint(a.join(b, "t_s").filter("ra < rb").join(cells, ["ra", "rb", "t_s"]))
    return out.select("ra", "rb", "t_s", r("mass_rel").alias("mass_rel"), r("d_depth").alias("d_depth"), r("d_wet").alias("d_wet"), r("rmse").alias("rmse"), r("iou").alias("iou"), "within")


CELL = "WITH w AS (SELECT *, CASE WHEN h > 0.05e0 THEN coalesce(lead(t_s) OVER (PARTITION BY run_id, row, col ORDER BY t_s) - t_s, 0) ELSE 0 END AS dt FROM fx_depth_ts), p AS (SELECT run_id, row, col, max(h) AS md, max(sqrt(u * u + v * v)) AS ms, min(t_s) FILTER (WHERE h > 0.05e0) / 3600e0 AS ah, sum(dt) / 3600e0 AS du FROM w GROUP BY run_id, row, col)"


@query("a13_flood_products", TS, q=f"{CELL} SELECT run_id, row, col, round(md, 6) AS max_depth, round(ms, 6) AS max_speed, round(ah, 6) AS arrival_h, round(du, 6) AS duration_h FROM p")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    p = op.flood_products(ts(spark, sf))
    return p.select("run_id", "row", "col", *[r(k).alias(k) for k in ("max_depth", "max_speed", "arrival_h", "duration_h")])


@query("a13_uncertainty", TS, q=f"{CELL} SELECT row, col, round(stddev_pop(md), 6) + 0e0 AS spread, count(*) AS runs FROM p GROUP BY row, col")
def a13_spread(spark: SparkSession, sf: str) -> DataFrame:
    return op.uncertainty(op.flood_products(ts(spark, sf))).select("row", "col", r("spread").alias("spread"), "runs")


GRID = ["run_id", "t_s"]


@query("w2_stencil", TS, q="SELECT a.run_id, a.t_s, a.row, a.col, round(min(b.h), 6) AS low, round(max(b.h), 6) AS high, round(avg(b.h), 11) AS mean FROM fx_depth_ts a JOIN fx_depth_ts b ON a.run_id = b.run_id AND a.t_s = b.t_s AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    from geofuse.plans.stencil import stencil

    t = ts(spark, sf).withColumns({"row": c("row").cast("int"), "col": c("col").cast("int")})
    for kind, out in (("min", "low"), ("max", "high"), ("mean", "mean")):
        t = stencil(t, GRID, "h", 2, kind, out)
    return t.select("run_id", "t_s", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), r("low").alias("low"), r("high").alias("high"), r("mean", 11).alias("mean"))


HAND = """m AS (SELECT a.run_id, a.t_s, a.row, a.col, a.h AS d, a.u + 3e0 AS z, min(b.u + 3e0) AS lo FROM fx_depth_ts a JOIN fx_depth_ts b ON a.run_id = b.run_id AND a.t_s = b.t_s AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL),
x AS (SELECT *, greatest(0e0, z - lo) AS hand FROM m), y AS (SELECT *, CASE WHEN hand < 0.3e0 THEN 0.3e0 - hand ELSE 0e0 END AS hh0 FROM x), g AS (SELECT *, CASE WHEN hh0 > 5e-4 THEN hh0 ELSE 0e0 END AS hh FROM y)"""


def _hand(spark: SparkSession, sf: str) -> DataFrame:
    t = ts(spark, sf).withColumns({"row": c("row").cast("int"), "col": c("col").cast("int"), "z": c("u") + 3.0, "d": c("h")})
    return op.hand(t, GRID, 2, 0.3)


@query("a14_hand", TS, q=f"WITH {HAND} SELECT run_id, t_s, row, col, round(hand, 6) + 0e0 AS hand, round(hh, 6) + 0e0 AS h FROM g")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return _hand(spark, sf).select("run_id", "t_s", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), r("hand").alias("hand"), r("h").alias("h"))


@query("a15_blend_hand", TS, q=f"WITH {HAND} SELECT run_id, t_s, row, col, round(CASE WHEN d < 0.55e0 * hh THEN greatest(d, 0.85e0 * hh) ELSE d END, 6) + 0e0 AS h FROM g")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    b = op.blend_hand(_hand(spark, sf).withColumns({"hand_h": c("h")}).withColumn("h", c("d")))
    return b.select("run_id", "t_s", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), r("h").alias("h"))


@query("a16_downsample", TS, q="SELECT run_id, t_s, CAST(floor(row / 5e0) AS INT) AS row, CAST(floor(col / 5e0) AS INT) AS col, round(avg(h), 11) AS h FROM fx_depth_ts WHERE row < 15 AND col < 20 GROUP BY run_id, t_s, floor(row / 5e0), floor(col / 5e0)")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return op.downsample(ts(spark, sf), GRID, 16, 24, 5).select("run_id", "t_s", "row", "col", r("h", 11).alias("h"))


@query("a17_resample_bilinear", TS, q="""WITH g AS (SELECT DISTINCT run_id, t_s FROM fx_depth_ts), t AS (SELECT g.*, CAST(i AS INT) AS row, CAST(j AS INT) AS col, (j + 0.5e0) / 36 * 23 AS u, (i + 0.5e0) / 10 * 15 AS v FROM g, range(0, 10) a(i), range(0, 36) b(j)),
q AS (SELECT *, CAST(floor(u) AS INT) AS x0, CAST(floor(v) AS INT) AS y0, u - floor(u) AS fx, v - floor(v) AS fy FROM t)
SELECT q.run_id, q.t_s, q.row, q.col, round(coalesce(a.h, 0e0) * (1 - fx) * (1 - fy) + coalesce(b.h, 0e0) * fx * (1 - fy) + coalesce(c.h, 0e0) * (1 - fx) * fy + coalesce(d.h, 0e0) * fx * fy, 11) AS h FROM q
LEFT JOIN fx_depth_ts a ON a.run_id = q.run_id AND a.t_s = q.t_s AND a.row = y0 AND a.col = x0 LEFT JOIN fx_depth_ts b ON b.run_id = q.run_id AND b.t_s = q.t_s AND b.row = y0 AND b.col = least(x0 + 1, 23)
LEFT JOIN fx_depth_ts c ON c.run_id = q.run_id AND c.t_s = q.t_s AND c.row = least(y0 + 1, 15) AND c.col = x0 LEFT JOIN fx_depth_ts d ON d.run_id = q.run_id AND d.t_s = q.t_s AND d.row = least(y0 + 1, 15) AND d.col = least(x0 + 1, 23)""")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    t = ts(spark, sf)
    out = op.resample_bilinear(t, t.select(*GRID).distinct(), GRID, 16, 24, 10, 36, "h")
    return out.select("run_id", "t_s", "row", "col", r("h", 11).alias("h"))


SIDES = " AND ".join(f"EXISTS (SELECT 1 FROM fx_depth_ts b WHERE b.run_id = a.run_id AND b.t_s = a.t_s AND b.row = a.row {dr} AND b.col = a.col {dc} AND b.h > 2e-3)" for dr, dc in (("+ 1", ""), ("- 1", ""), ("", "+ 1"), ("", "- 1")))


@query("w4_shoreline", TS, q=f"SELECT run_id, t_s, row, col FROM fx_depth_ts a WHERE h > 2e-3 AND NOT ({SIDES})")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return op.shoreline(ts(spark, sf), GRID).select("run_id", "t_s", "row", "col")


@query("w3_surface_slope", TS, q="""WITH e AS (SELECT *, u + h AS eta FROM fx_depth_ts)
SELECT a.run_id, a.t_s, a.row, a.col, round(CASE WHEN l.eta IS NULL AND n.eta IS NULL THEN 0e0 ELSE (coalesce(n.eta, a.eta) - coalesce(l.eta, a.eta)) / (((l.eta IS NOT NULL)::INT + (n.eta IS NOT NULL)::INT) * 10e0) END, 10) + 0e0 AS slope_x,
 round(CASE WHEN s.eta IS NULL AND o.eta IS NULL THEN 0e0 ELSE (coalesce(o.eta, a.eta) - coalesce(s.eta, a.eta)) / (((s.eta IS NOT NULL)::INT + (o.eta IS NOT NULL)::INT) * 10e0) END, 10) + 0e0 AS slope_y FROM e a
LEFT JOIN e l ON l.run_id = a.run_id AND l.t_s = a.t_s AND l.row = a.row AND l.col = a.col - 1 LEFT JOIN e n ON n.run_id = a.run_id AND n.t_s = a.t_s AND n.row = a.row AND n.col = a.col + 1
LEFT JOIN e s ON s.run_id = a.run_id AND s.t_s = a.t_s AND s.row = a.row - 1 AND s.col = a.col LEFT JOIN e o ON o.run_id = a.run_id AND o.t_s = a.t_s AND o.row = a.row + 1 AND o.col = a.col""")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    s = op.surface_slope(ts(spark, sf).withColumn("z", c("u")), GRID, 10.0)
    return s.select("run_id", "t_s", "row", "col", r("slope_x", 10).alias("slope_x"), r("slope_y", 10).alias("slope_y"))


@query("w9_lerp_states", TS, q="""WITH q AS (SELECT * FROM (SELECT DISTINCT run_id FROM fx_depth_ts) r, (SELECT o_orderkey AS q_id, mod(o_orderkey * 37, 7200) * 1e0 AS q_t FROM orders WHERE mod(o_orderkey, 50) = 0) o),
b AS (SELECT q.run_id, q_id, q_t, max(t_s) FILTER (WHERE t_s <= q_t) AS a0, min(t_s) FILTER (WHERE t_s >= q_t) AS a1 FROM q JOIN (SELECT DISTINCT run_id, t_s FROM fx_depth_ts) s ON s.run_id = q.run_id GROUP BY ALL),
d AS (SELECT run_id, q_id, q_t, coalesce(a0, a1) AS t0, coalesce(a1, a0) AS t1 FROM b)
SELECT d.run_id, q_id, x.row, x.col, round(x.h + (y.h - x.h) * CASE WHEN t1 > t0 THEN (q_t - t0) / (t1 - t0) ELSE 0e0 END, 9) + 0e0 AS h FROM d JOIN fx_depth_ts x ON x.run_id = d.run_id AND x.t_s = t0 JOIN fx_depth_ts y ON y.run_id = d.run_id AND y.t_s = t1 AND y.row = x.row AND y.col = x.col""")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    t = ts(spark, sf)
    asked = sql(spark, sf, "SELECT o_orderkey AS q_id, mod(o_orderkey * 37, 7200) * 1e0 AS q_t FROM orders WHERE mod(o_orderkey, 50) = 0")
    runs = t.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id")
    out = op.lerp_states(t, asked.withColumn("run_id", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))).join(runs, "run_id"))
    return out.select("run_id", "q_id", "row", "col", r("h", 9).alias("h"))


@query("p22_hazard", "fx_hydrograph", q="""SELECT sample_id, CASE WHEN stage_m >= 1.6e0 OR discharge_cms >= 70 THEN 3 WHEN stage_m >= 1e0 OR discharge_cms >= 45 THEN 2 WHEN stage_m >= 0.4e0 OR discharge_cms >= 20 THEN 1 ELSE 0 END AS timeline,
 CASE WHEN stage_m >= 1.6e0 THEN 3 WHEN stage_m >= 1e0 THEN 2 WHEN stage_m >= 0.35e0 THEN 1 ELSE 0 END AS cell FROM fx_hydrograph""")
def p22(spark: SparkSession, sf: str) -> DataFrame:
    h = view(spark, sf, "fx_hydrograph")
    return h.select("sample_id", f.hazard_timeline(c("stage_m"), c("discharge_cms")).alias("timeline"), f.hazard_cell(c("stage_m")).alias("cell"))


T01 = "greatest(0e0, least(1e0, h / 4e0))"


@query("p23_depth_rgba", TS, q=f"""SELECT run_id, t_s, row, col, CASE WHEN h <= 5e-4 THEN 0 ELSE CAST(floor(37 - 29 * {T01} + 0.5e0) AS INT) END AS red, CASE WHEN h <= 5e-4 THEN 0 ELSE CAST(floor(55 + {T01} * 160 + 0.5e0) AS INT) END AS alpha,
 CASE WHEN h <= 5e-4 THEN 0 WHEN h >= 1.6e0 THEN 210 WHEN h >= 1e0 THEN 170 WHEN h >= 0.35e0 THEN 140 ELSE 90 END AS hazard_alpha, CASE WHEN h <= 5e-4 THEN 0 ELSE CAST(floor(40 + {T01} * 50 + 0.5e0) AS INT) END AS contour_alpha FROM fx_depth_ts""")
def p23(spark: SparkSession, sf: str) -> DataFrame:
    rgba = lambda style: f.depth_rgba(c("h"), F.lit(4.0), style)
    return ts(spark, sf).select("run_id", "t_s", "row", "col", rgba("depth")["r"].alias("red"), rgba("depth")["a"].alias("alpha"), rgba("hazard")["a"].alias("hazard_alpha"), rgba("contour")["a"].alias("contour_alpha"))


@query("p24_flood_snapshot", "fx_hydrograph", q="""WITH p AS (SELECT *, least(1e0, stage_m / max(stage_m) OVER (PARTITION BY series_id)) AS i FROM fx_hydrograph)
SELECT sample_id, round(greatest(0e0, stage_m - 0.3e0), 6) AS max_depth, round(least(0.92e0, 0.08e0 + i * 0.72e0), 6) AS wet_fraction,
 CASE WHEN i < 0.15e0 THEN 'Dry / low water' WHEN i < 0.45e0 THEN 'Rising' WHEN i < 0.75e0 THEN 'Near peak' WHEN i < 0.92e0 THEN 'Peak / high water' ELSE 'Receding' END AS status FROM p""")
def p24(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.least(F.lit(1.0), c("stage_m") / F.max("stage_m").over(Window.partitionBy("series_id")))
    h = view(spark, sf, "fx_hydrograph").withColumn("i", i)
    return h.select("sample_id", r(F.greatest(F.lit(0.0), c("stage_m") - 0.3)).alias("max_depth"), r(F.least(F.lit(0.92), 0.08 + c("i") * 0.72)).alias("wet_fraction"), f.status_label(c("i")).alias("status"))


@query("p25_stage_forcing", "fx_hydrograph", q="""WITH t AS (SELECT *, mod(sample_id, 101) / 100e0 AS t01, least(1.4e0, stage_m / 2.35e0) AS i FROM fx_hydrograph)
SELECT sample_id, round(1.5e0 * sin(least(1e0, t01 / 0.4e0) * (pi() / 2)) * CASE WHEN t01 <= 0.4e0 THEN 1e0 ELSE exp(-(t01 - 0.4e0) / 0.35e0) END, 6) + 0e0 AS stage, round(2 + i * 38, 6) AS rain, round(discharge_cms * 0.35e0, 6) AS inflow, round(1.5e0 + (1 - i) * 2, 6) AS infiltration FROM t""")
def p25(spark: SparkSession, sf: str) -> DataFrame:
    fo = f.forcing(c("stage_m"), c("discharge_cms"))
    h = view(spark, sf, "fx_hydrograph")
    return h.select("sample_id", r(f.hand_stage(c("sample_id") % 101 / 100)).alias("stage"), r(fo["rain_mm_h"]).alias("rain"), r(fo["inflow_cms"]).alias("inflow"), r(fo["infiltration_mm_h"]).alias("infiltration"))


@query("p26_ensemble_scales", q="""SELECT o_orderkey AS scenario, CAST(i AS INT) AS i, round(CASE WHEN n <= 1 THEN 0.5e0 ELSE i * 1e0 / (n - 1) END * 0.4e0 + 0.8e0, 6) AS scale FROM (SELECT o_orderkey, mod(o_orderkey, 5) + 1 AS n, unnest(range(0, mod(o_orderkey, 5) + 1)) AS i FROM orders) z""")
def p26(spark: SparkSession, sf: str) -> DataFrame:
    n = c("o_orderkey") % 5 + 1
    o = sql(spark, sf, "SELECT o_orderkey FROM orders").withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), (c("n") - 1).cast("int"))))
    t = F.when(c("n") <= 1, 0.5).otherwise(c("i") / (c("n") - 1))
    return o.select(c("o_orderkey").alias("scenario"), "i", r(0.8 + t * 0.4).alias("scale"))


@query("p27_authority", q="SELECT o_orderkey AS run, CASE mod(o_orderkey, 3) WHEN 0 THEN 'anuga' ELSE 'demo' END = 'anuga' AND CASE mod(o_orderkey, 4) WHEN 0 THEN 'calibrated' WHEN 1 THEN 'validated' ELSE 'draft' END IN ('calibrated', 'validated') AS authoritative FROM orders")
def p27(spark: SparkSession, sf: str) -> DataFrame:
    o = sql(spark, sf, "SELECT o_orderkey AS run, CASE mod(o_orderkey, 3) WHEN 0 THEN 'anuga' ELSE 'demo' END AS mode, CASE mod(o_orderkey, 4) WHEN 0 THEN 'calibrated' WHEN 1 THEN 'validated' ELSE 'draft' END AS state FROM orders")
    return o.select("run", f.authority(c("mode"), c("state")).alias("authoritative"))


@query("p30_cell_of_point", "fx_site", q="SELECT site_id, CAST(least(95, floor((lon + 180e0) / 360e0 * 96)) AS INT) AS col, CAST(least(71, floor((lat + 80e0) / 160e0 * 72)) AS INT) AS row FROM fx_site WHERE lon >= -180 AND lon <= 180 AND lat >= -80 AND lat <= 80")
def p30(spark: SparkSession, sf: str) -> DataFrame:
    u, v = (c("lon") + 180) / 360, (c("lat") + 80) / 160
    s = view(spark, sf, "fx_site").filter(u.between(0, 1) & v.between(0, 1))
    return s.select("site_id", F.least(F.lit(95), F.floor(u * 96)).cast("int").alias("col"), F.least(F.lit(71), F.floor(v * 72)).cast("int").alias("row"))


@query("u3_wet_extent_sets", TS, q="""WITH w AS (SELECT run_id, t_s, row, col FROM fx_depth_ts WHERE h > 5e-4) SELECT t_s, count(*) FILTER (WHERE n = 3) AS in_all, count(*) AS in_any FROM (SELECT t_s, row, col, count(DISTINCT run_id) AS n FROM w GROUP BY ALL) z GROUP BY t_s""")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    """Cells wet in all runs, and in any, by set operations."""
    w = ts(spark, sf).filter(c("h") > f.H_DRY)
    a, b, d = (w.filter(c("run_id") == k).select("t_s", "row", "col") for k in "ANR")
    every = a.intersect(b).intersect(d).groupBy("t_s").agg(F.count(F.lit(1)).alias("in_all"))
    some = a.union(b).union(d).distinct().groupBy("t_s").agg(F.count(F.lit(1)).alias("in_any"))
    return some.join(every, "t_s", "left").select("t_s", F.coalesce("in_all", F.lit(0)).cast("long").alias("in_all"), "in_any")

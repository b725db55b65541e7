"""Depth tables: statistics, comparison, products, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofuse.functions.flood import H_DRY, TOLERANCE, hazard_stats
from geofuse.plans.stencil import beside, stencil

c = F.col


def depth_stats(ts: DataFrame, dx: float = 10.0) -> DataFrame:
    """Per run and time: wet cells, greatest and mean wet depth, mass, speed, wet share of the cells given, hazard."""
    wet = c("h") > H_DRY
    s = ts.groupBy("run_id", "t_s").agg(
        F.count_if(wet).alias("wet_cells"), F.coalesce(F.max(F.when(wet, c("h"))), F.lit(0.0)).alias("max_depth"),
        F.coalesce(F.avg(F.when(wet, c("h"))), F.lit(0.0)).alias("mean_depth"), F.coalesce(F.sum(F.when(wet, c("h") * dx * dx)), F.lit(0.0)).alias("mass"),
        F.coalesce(F.max(F.when(wet, F.hypot("u", "v"))), F.lit(0.0)).alias("max_speed"), (F.count_if(wet) / F.count(F.lit(1))).alias("wet_fraction"),
    )
    return s.withColumn("hazard", hazard_stats(c("max_depth"), c("max_speed")))


def compare_cells(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Depth RMSE and wet-extent IoU of two states with the same cells; null where the cells differ."""
    both = a.select(*by, "row", "col", c("h").alias("ha")).join(b.select(*by, "row", "col", c("h").alias("hb")), [*by, "row", "col"], "full")
    wa, wb = c("ha") > H_DRY, c("hb") > H_DRY
    same = F.count_if(c("ha").isNull() | c("hb").isNull()) == 0
    union = F.count_if(wa | wb)
    return both.groupBy(*by).agg(
        F.when(same, F.sqrt(F.avg((c("ha") - c("hb")) * (c("ha") - c("hb"))))).alias("rmse"),
        F.when(same, F.when(union > 0, F.count_if(wa & wb) / union).otherwise(1.0)).alias("iou"),
    )


def compare_checkpoint(joined: DataFrame, tol: dict[str, float] = TOLERANCE) -> DataFrame:
    """Rows with mass, max_depth, wet_fraction and those of a checkpoint (ck_*): errors, and whether all are within tolerance."""
    mass = F.when(c("ck_mass") > 1e-3, F.abs(c("mass") - c("ck_mass")) / c("ck_mass")).when(c("mass") < 1e-3, 0.0).otherwise(1.0)
    out = joined.withColumns({"mass_rel": mass, "d_depth": F.abs(c("max_depth") - c("ck_max_depth")), "d_wet": F.abs(c("wet_fraction") - c("ck_wet_fraction"))})
    ok = (c("mass_rel") <= tol["mass"]) & (c("d_depth") <= tol["depth"]) & (c("d_wet") <= tol["wet"])
    if "rmse" in joined.columns:
        ok = ok & F.coalesce(c("rmse") <= tol["rmse"], F.lit(True)) & F.coalesce(c("iou") >= tol["iou"], F.lit(True))
    return out.withColumn("within", ok)


def flood_products(ts: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Per run and cell: greatest depth and speed, first wet hour, wet hours."""
    w = Window.partitionBy("run_id", "row", "col").orderBy("t_s")
    wet = c("h") > threshold
    step = ts.withColumn("dt", F.when(wet, F.coalesce(F.lead("t_s").over(w) - c("t_s"), F.lit(0))).otherwise(0))
    return step.groupBy("run_id", "row", "col").agg(
        F.max("h").alias("max_depth"), F.max(F.hypot("u", "v")).alias("max_speed"),
        (F.min(F.when(wet, c("t_s"))) / 3600).alias("arrival_h"), (F.sum("dt") / 3600).alias("duration_h"),
    )


def uncertainty(products: DataFrame) -> DataFrame:
    """Spread of the greatest depth over the runs of an ensemble, per cell."""
    return products.groupBy("row", "col").agg(F.stddev_pop("max_depth").alias("spread"), F.count(F.lit(1)).alias("runs"))


def hand(cells: DataFrame, grid: list[str], radius: int, stage: float, residual: float = 0.0) -> DataFrame:
    """Height above the lowest cell around, and the depth at a stage."""
    low = stencil(cells, grid, "z", radius, "min", "z_low").withColumn("hand", F.greatest(F.lit(0.0), c("z") - c("z_low")))
    dry = residual * 0.15 if residual > H_DRY else 0.0
    h = F.when(c("hand") < max(0.0, stage), F.greatest(F.lit(residual), F.lit(max(0.0, stage)) - c("hand"))).otherwise(dry)
    return low.withColumn("h", F.when(h > H_DRY, h).otherwise(0.0)).drop("z_low")


def blend_hand(cells: DataFrame) -> DataFrame:
    """Where the depth is well below the HAND depth, most of that."""
    return cells.withColumn("h", F.when(c("h") < 0.55 * c("hand_h"), F.greatest(c("h"), 0.85 * c("hand_h"))).otherwise(c("h")))


def downsample(cells: DataFrame, grid: list[str], rows: int, cols: int, f: int, value: str = "h") -> DataFrame:
    """Means of f by f blocks; what is left over at the edges is dropped."""
    inside = cells.filter((c("row") < rows // f * f) & (c("col") < cols // f * f))
    return inside.groupBy(*grid, F.floor(c("row") / f).cast("int").alias("row"), F.floor(c("col") / f).cast("int").alias("col")).agg(F.avg(value).alias(value))


def resample_bilinear(cells: DataFrame, grids: DataFrame, grid: list[str], rows: int, cols: int, to_rows: int, to_cols: int, value: str = "z") -> DataFrame:
    """Each grid on another lattice: four taps per target, joined by cell; missing taps count as zero."""
    t = grids.select(*grid, F.explode(F.sequence(F.lit(0), F.lit(to_rows - 1))).alias("trow")).withColumn("tcol", F.explode(F.sequence(F.lit(0), F.lit(to_cols - 1))))
    u = (c("tcol") + 0.5) / to_cols * (cols - 1)
    v = (c("trow") + 0.5) / to_rows * (rows - 1)
    t = t.withColumns({"u": u, "v": v}).withColumns({"x0": F.floor("u").cast("int"), "y0": F.floor("v").cast("int")})
    t = t.withColumns({"fx": c("u") - c("x0"), "fy": c("v") - c("y0")})
    one = F.lit(1)
    last = lambda x, n: F.least(x + one, F.lit(n - 1))
    taps = [(c("y0"), c("x0"), (1 - c("fx")) * (1 - c("fy"))), (c("y0"), last(c("x0"), cols), c("fx") * (1 - c("fy"))),
            (last(c("y0"), rows), c("x0"), (1 - c("fx")) * c("fy")), (last(c("y0"), rows), last(c("x0"), cols), c("fx") * c("fy"))]
    tap = F.explode(F.array(*[F.struct(a.alias("row"), b.alias("col"), w.alias("w")) for a, b, w in taps]))
    e = t.select(*grid, "trow", "tcol", tap.alias("tap")).select(*grid, "trow", "tcol", "tap.*")
    met = e.join(cells.select(*grid, "row", "col", value), [*grid, "row", "col"], "left")
    return met.groupBy(*grid, c("trow").alias("row"), c("tcol").alias("col")).agg(F.sum(c("w") * F.coalesce(c(value), F.lit(0.0))).alias(value))


def shoreline(cells: DataFrame, grid: list[str]) -> DataFrame:
    """Wet cells with a dry or missing neighbour."""
    wet = F.col("h") > 4 * H_DRY
    cells = cells.withColumn("wet", wet)
    sides = [F.coalesce(beside(grid, axis, step, "wet"), F.lit(False)) for axis in ("row", "col") for step in (1, -1)]
    return cells.withColumn("inner", sides[0] & sides[1] & sides[2] & sides[3]).filter("wet AND NOT inner").drop("wet", "inner")


def surface_slope(cells: DataFrame, grid: list[str], dx: float) -> DataFrame:
    """Slopes of the water surface: central differences, one-sided at edges."""
    cells = cells.withColumn("eta", c("z") + c("h"))

    def slope(axis: str):
        a, b = beside(grid, axis, -1, "eta"), beside(grid, axis, 1, "eta")
        n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
        return F.when(n > 0, (F.coalesce(b, c("eta")) - F.coalesce(a, c("eta"))) / (n * dx)).otherwise(0.0)

    return cells.withColumns({"slope_x": slope("col"), "slope_y": slope("row")})


def lerp_states(ts: DataFrame, times: DataFrame) -> DataFrame:
    """Each run's cells at asked times, between the two snapshots around; cells in both alone."""
    # One sorted pass over asked times and snapshots together, per run: the snapshot at or before, and at or after.
    snaps = ts.select("run_id", c("t_s").cast("double").alias("at"), c("t_s").alias("t_s")).distinct()
    asked = times.select("run_id", "q_id", "q_t", c("q_t").cast("double").alias("at"))
    both = asked.unionByName(snaps, allowMissingColumns=True)
    w = Window.partitionBy("run_id").orderBy("at")
    both = both.withColumns({
        "t0": F.max("t_s").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "t1": F.min("t_s").over(Window.partitionBy("run_id").orderBy(c("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    q = both.filter("q_id IS NOT NULL").select("run_id", "q_id", "q_t", "t0", "t1").filter("t0 IS NOT NULL OR t1 IS NOT NULL")
    q = q.withColumns({"t0": F.coalesce("t0", "t1"), "t1": F.coalesce("t1", "t0")})
    a = ts.select("run_id", c("t_s").alias("t0"), "row", "col", c("h").alias("h0"))
    b = ts.select("run_id", c("t_s").alias("t1"), "row", "col", c("h").alias("h1"))
    met = q.join(a, ["run_id", "t0"]).join(b, ["run_id", "t1", "row", "col"])
    share = F.when(c("t1") > c("t0"), (c("q_t") - c("t0")) / (c("t1") - c("t0"))).otherwise(0.0)
    return met.select("run_id", "q_id", "row", "col", (c("h0") + (c("h1") - c("h0")) * share).alias("h"))

"""Point clouds and splats."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofuse.functions import camera as cam
from geofuse.functions import splat as sp
from geofuse.plans.rank import nth_smallest, ranked
from geofuse.plans.shared import attach, few, salt_bit, salt_of, stored

c = F.col
#: Cells along the longest side of a cloud, and how far beyond its image a view still sees, as a part of the image.
CELLS, BORDER = 32, 0.1
# Block names by colour, in the order that decides ties.
PALETTE = (
    ("white", 207, 213, 214), ("orange", 224, 97, 0), ("magenta", 169, 48, 159), ("light_blue", 36, 137, 199), ("yellow", 241, 175, 21), ("lime", 94, 169, 24), ("pink", 214, 101, 143),
    ("gray", 55, 58, 62), ("light_gray", 125, 125, 115), ("cyan", 21, 119, 136), ("purple", 100, 32, 156), ("blue", 45, 47, 143), ("brown", 96, 60, 32), ("green", 73, 91, 36), ("red", 142, 33, 33), ("black", 8, 10, 15),
)


def decode(splats: DataFrame) -> DataFrame:
    """Adds linear scales sx sy sz, opacity, unit quaternion uw ux uy uz and colours red green blue."""
    w, x, y, z = sp.unit_quaternion(c("qw"), c("qx"), c("qy"), c("qz"))
    red, green, blue = sp.rgb(c("dc0"), c("dc1"), c("dc2"))
    return splats.withColumns({
        "sx": F.exp("s0"), "sy": F.exp("s1"), "sz": F.exp("s2"), "opacity": sp.opacity(c("opacity_logit")),
        "uw": w, "ux": x, "uy": y, "uz": z, "red": red, "green": green, "blue": blue,
    })


def covariance(splats: DataFrame) -> DataFrame:
    d = decode(splats)
    return d.withColumns(sp.covariance(sp.rotation(c("uw"), c("ux"), c("uy"), c("uz")), [c("sx"), c("sy"), c("sz")]))


def transform(splats: DataFrame, rot: list[list[float]], quaternion: tuple[float, ...], scale: float, pivot: tuple[float, ...], shift: tuple[float, ...]) -> DataFrame:
    """Positions turned and scaled about a pivot and shifted; rotations composed on the left; log-scales raised."""
    d = [(c(k) - p) * scale for k, p in zip("xyz", pivot)]
    moved = {k: sum((rot[i][j] * d[j] for j in range(3)), F.lit(0.0)) + pivot[i] + shift[i] for i, k in enumerate("xyz")}
    a, (w, x, y, z) = quaternion, (c("qw"), c("qx"), c("qy"), c("qz"))
    turned = {
        "qw": a[0] * w - a[1] * x - a[2] * y - a[3] * z, "qx": a[0] * x + a[1] * w + a[2] * z - a[3] * y,
        "qy": a[0] * y - a[1] * z + a[2] * w + a[3] * x, "qz": a[0] * z + a[1] * y - a[2] * x + a[3] * w,
    }
    return splats.withColumns(moved | turned | {k: c(k) + math.log(scale) for k in ("s0", "s1", "s2")})


def quantize(splats: DataFrame) -> DataFrame:
    w, x, y, z = sp.unit_quaternion(c("qw"), c("qx"), c("qy"), c("qz"))
    d = splats.withColumns({"uw": w, "ux": x, "uy": y, "uz": z})
    return d.select(
        "splat_id", *[sp.fixed24(c(k)).alias(f"p{k}") for k in "xyz"], sp.byte(sp.opacity(c("opacity_logit")) * 255).alias("alpha"),
        *[sp.colour_byte(c(f"dc{i}")).alias(f"c{i}") for i in range(3)], *[sp.log_scale_byte(c(f"s{i}")).alias(f"l{i}") for i in range(3)],
        *[v.alias(k) for k, v in sp.smallest_three(c("uw"), c("ux"), c("uy"), c("uz")).items()],
    )


def cloud_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group centroid, rms radius, bounds and count: one map-side combined aggregate. Rows without a group take no part.

    The mean square around the centroid is the variance, and the square of how far the mean of the rows that have all three
    coordinates, which alone count for it, lies from the centroid.
    """
    whole = {k: F.when(F.coalesce(*[F.when(c(j).isNull(), 1) for j in "xyz"]).isNull(), c(k)) for k in "xyz"}
    d2 = sum((F.var_pop(w) + F.pow(F.avg(w) - F.avg(k), 2) for k, w in whole.items()), F.lit(0.0))
    known = functools.reduce(lambda a, b: a & b, [c(k).isNotNull() for k in by], F.lit(True))
    return df.filter(known).groupBy(*by).agg(
        *[F.avg(k).alias(f"m{k}") for k in "xyz"], F.sqrt(d2).alias("rms"), *[f(k).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xyz"], F.count(F.lit(1)).alias("n")
    )


def robust_radius(df: DataFrame, by: list[str], quantile: float = 0.9, floor: float = 1e-4) -> DataFrame:
    """Per group the centroid and the distance from it at a rank of floor((n - 1) * quantile)."""
    salted = df.select(*by, *"xyz", salt_of(*"xyz").alias("salt"))
    mean = salted.groupBy(*by).agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"], F.bit_or(salt_bit(c("salt"))).alias("salts"))
    away = F.sqrt(sum(((c(k) - c(f"m{k}")) * (c(k) - c(f"m{k}")) for k in "xyz"), F.lit(0.0)))
    d = attach(salted, mean, by).select(*by, away.alias("radius"))
    mean = mean.drop("salts")
    r = nth_smallest(d, "radius", F.floor((c("n") - 1) * quantile), by)
    return mean.join(r, by).withColumn("radius", F.greatest(c("radius"), F.lit(floor)))


def lerp_clouds(a: DataFrame, b: DataFrame, by: list[str], share: float) -> DataFrame:
    """Splats between two states of a cloud, by id: positions, log-scales, opacities and colours; share is held within 0 to 1.

    A splat that only one state has is left out.
    """
    t = min(max(share, 0.0), 1.0)
    cols = [k for k in (*"xyz", "s0", "s1", "s2", "opacity_logit", "dc0", "dc1", "dc2") if k in a.columns and k in b.columns]
    both = a.select(*by, *cols).join(b.select(*by, *[c(k).alias(f"b_{k}") for k in cols]), by)
    return both.select(*by, *[(c(k) + (c(f"b_{k}") - c(k)) * t).alias(k) for k in cols])


def fuse_voxels(evidence: DataFrame, scene: float) -> DataFrame:
    """Confidence-weighted means of the points in each voxel; preserved points stay out of it."""
    voxel = min(max(0.0025 * scene, 1e-4), 0.05)
    kept = evidence.filter((c("confidence") >= 0.15) & ~(c("preserve") & (c("confidence") >= 0.7)))
    cell = [F.floor(c(k) / voxel).alias(f"v{k}") for k in "xyz"]
    w = c("confidence")
    mean = lambda k: F.sum(c(k) * w) / F.sum(w)
    return kept.groupBy(*cell).agg(*[mean(k).alias(k) for k in "xyz"], *[F.floor(mean(k) + 0.5).cast("int").alias(k) for k in "rgb"], F.sum(w).alias("weight"))


def fuse_evidence(evidence: DataFrame, scene: float, most: int) -> DataFrame:
    """Fused voxels by weight under the budget that preserved points leave, then preserved points up to most, the surest first."""
    preserved = evidence.filter(c("preserve") & (c("confidence") >= 0.7)).select("confidence", *"xyz", *[c(k).cast("int").alias(k) for k in "rgb"])
    kept = stored(preserved, "preserved")
    budget = most - min(kept.count(), most // 5)
    # Places in the order come from ranges, so that a budget of millions isn't merged in one task.
    one = F.lit(0).alias("all")
    fused = ranked(fuse_voxels(evidence, scene).select(one, "*", (-c("weight")).alias("light")), ["all"], ["light", "vx", "vy", "vz"])
    fused = stored(fused.filter(c("rank") < budget).select(*"xyz", *"rgb", F.lit("fused").alias("kind")), "fused")
    left = max(0, most - fused.count())
    more = ranked(kept.select(one, "*", (-c("confidence")).alias("light")), ["all"], ["light", *"xyz", *"rgb"]).filter(c("rank") < left)
    return fused.unionByName(more.select(*"xyz", *"rgb", F.lit("preserved").alias("kind")))


def nearest_palette(r, g, b):
    """The block of least squared distance, the first of equals: a fold over 16 literals, no join."""
    best = F.least(*[F.struct(((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, x, y, z) in enumerate(PALETTE)])
    return best["n"]


def voxelize(splats: DataFrame, extent: int = 64, quantile: float = 0.95, least_opacity: float = 0.1) -> DataFrame:
    """Blocks of the opaque splats in the robust ball: stamped by scale, coloured by weighted mean and palette."""
    d = decode(splats).withColumn("all", F.lit(0))
    ball = robust_radius(d, ["all"], quantile).first()  # a row
    if ball is None:
        return splats.sparkSession.createDataFrame([], "bx long, by long, bz long, weight double, block string")
    block = max(2 * ball["radius"], 1e-3) / extent
    d2 = sum(((c(k) - ball[f"m{k}"]) * (c(k) - ball[f"m{k}"]) for k in "xyz"), F.lit(0.0))
    kept = d.filter((c("opacity") >= least_opacity) & (d2 <= (1.05 * ball["radius"]) ** 2))
    box = kept.agg(*[f(k).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in "xyz"]).first()
    if box["lox"] is None:
        return splats.sparkSession.createDataFrame([], "bx long, by long, bz long, weight double, block string")
    low = {k: box[f"lo{k}"] - block / 2 for k in "xyz"}
    size = {k: max(1, math.ceil(max(box[f"hi{k}"] + block / 2 - low[k], block) / block)) for k in "xyz"}
    reach = F.least(F.lit(2), F.ceil((c("sx") + c("sy") + c("sz")) / 3 / block)).cast("int")
    s = kept.select(*[F.floor((c(k) - low[k]) / block).alias(f"f{k}") for k in "xyz"], reach.alias("reach"), F.greatest("opacity", F.lit(0.05)).alias("w"), "red", "green", "blue")
    for k in "xyz":
        s = s.withColumn(f"o{k}", F.explode(F.sequence(-c("reach"), c("reach"))))
    s = s.select(*[(c(f"f{k}") + c(f"o{k}")).alias(f"b{k}") for k in "xyz"], (c("w") / (1 + c("ox") * c("ox") + c("oy") * c("oy") + c("oz") * c("oz"))).alias("w"), "red", "green", "blue")
    for k in "xyz":
        s = s.filter((c(f"b{k}") >= 0) & (c(f"b{k}") < size[k]))
    v = s.groupBy("bx", "by", "bz").agg(F.sum("w").alias("weight"), *[(F.sum(c(k) * c("w")) / F.sum("w")).alias(k) for k in ("red", "green", "blue")])
    return v.filter("weight >= 1e-4").select("bx", "by", "bz", "weight", nearest_palette(c("red"), c("green"), c("blue")).alias("block"))


def view_candidates(splats: DataFrame, views: DataFrame, cells: int = CELLS) -> DataFrame:
    """Splats with the views that may see them: those whose frustum meets the ball around the splats of their cell.

    A lattice of cells along the longest side of the cloud gives at most (cells + 1) ** 3 balls, each as small as its splats
    allow; balls are set against frusta, and splats meet only the views that their ball is left with. The splats of a
    crowded cell are spread over salts. views is broadcast: the cameras of one model, whose number is checked.
    """
    v = views.select("image_id", "f", "width", "height", *[c(k).alias(f"v_{k}") for k in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
    s = splats.filter(" AND ".join(f"abs({k}) < double('inf')" for k in "xyz"))
    box = s.agg(*[f(k).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in "xyz"]).first()
    low = {k: float(box[f"lo{k}"] or 0) for k in "xyz"}
    edge = max((float(box[f"hi{k}"] or 0) - low[k] for k in "xyz"), default=0) / cells or 1.0
    keys = [f"_cell_{k}" for k in "xyz"]
    s = s.withColumns({n: F.floor((c(k) - low[k]) / edge).cast("int") for n, k in zip(keys, "xyz")} | {"_salt": salt_of(*"xyz")})
    balls = s.groupBy(*keys).agg(*[f(k).cast("double").alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in "xyz"], F.bit_or(salt_bit(c("_salt"))).alias("salts"))
    half = [(c(f"hi{k}") - c(f"lo{k}")) / 2 for k in "xyz"]
    met = balls.withColumn("_r", F.sqrt(sum((h * h for h in half), F.lit(0.0))) * (1 + 1e-9) + 1e-9).join(few(v, what="views"))
    p = cam.world_to_cam((c("v_qw"), c("v_qx"), c("v_qy"), c("v_qz")), (c("v_tx"), c("v_ty"), c("v_tz")), tuple(c(f"lo{k}") + h for k, h in zip("xyz", half)))
    met = met.withColumns({f"_p{i}": p[i] for i in range(3)}).filter(c("_p2") + c("_r") > 0)
    for i, side in enumerate(("width", "height")):
        # Seen from where both planes of a side meet, the ball reaches over neither of them.
        wide = (0.5 + BORDER) * c(side)
        met = met.filter(c("f") * F.abs(f"_p{i}") - wide * c("_p2") <= c("_r") * F.sqrt(c("f") * c("f") + wide * wide) * (1 + 1e-9))
    pairs = met.select(*keys, "salts", *v.columns)
    return attach(s, pairs, keys, salt="_salt").drop(*keys, "_salt")


def in_views(splats: DataFrame, views: DataFrame, cells: int = CELLS) -> DataFrame:
    """Splats with the views that see them, ten percent of border included; by cells of splats first (view_candidates)."""
    both = view_candidates(splats, views, cells)
    p = cam.world_to_cam((c("v_qw"), c("v_qx"), c("v_qy"), c("v_qz")), (c("v_tx"), c("v_ty"), c("v_tz")), (c("x"), c("y"), c("z")))
    both = both.withColumns({"cx": p[0], "cy": p[1], "depth": p[2]}).filter("depth > 1e-4")
    u, w = cam.project([c("cx"), c("cy"), c("depth")], c("f"), c("width"), c("height"))
    seen = both.withColumns({"px": u, "py": w})
    lo, hi = -BORDER, 1 + BORDER
    return seen.filter((c("px") >= lo * c("width")) & (c("px") <= hi * c("width")) & (c("py") >= lo * c("height")) & (c("py") <= hi * c("height")))


def mip_filter(splats: DataFrame, views: DataFrame, size: float = 0.2, focal_scale: float = 1.0) -> DataFrame:
    """Scales widened to the finest rate at which a view samples the splat, and opacity lowered to match; unseen ones unchanged."""
    rate = in_views(splats.select("splat_id", *"xyz"), views).groupBy("splat_id").agg(F.max(c("f") / c("depth") * focal_scale).alias("nu"))
    d = splats.join(rate, "splat_id", "left").withColumn("v", F.pow(size / c("nu"), F.lit(2)))
    s2 = {k: F.exp(2 * c(k)) for k in ("s0", "s1", "s2")}
    share = F.sqrt(s2["s0"] / (s2["s0"] + c("v")) * (s2["s1"] / (s2["s1"] + c("v"))) * (s2["s2"] / (s2["s2"] + c("v"))))
    seen = F.coalesce(c("nu") > 1e-6, F.lit(False))
    alpha = sp.opacity(c("opacity_logit"))
    d = d.withColumn("opacity", F.when(seen, F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), alpha * share))).otherwise(alpha))
    return d.withColumns({k: F.when(seen, 0.5 * F.log(s2[k] + c("v"))).otherwise(c(k)) for k in s2}).withColumn("filtered", seen).drop("v")


def points_to_splats(points: DataFrame, scene: float) -> DataFrame:
    """Round splats of a size that follows from the number of points."""
    n = points.count()
    s = math.log(min(max(scene / max(n, 1) ** (1 / 3), 1e-4), 0.05))
    dc = {f"dc{i}": (c(k) / 255 - 0.5) / sp.SH_C0 for i, k in enumerate("rgb")}
    return points.withColumns({"s0": F.lit(s), "s1": F.lit(s), "s2": F.lit(s), "opacity_logit": F.lit(0.0), "qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)} | dc)

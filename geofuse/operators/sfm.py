"""Images, keypoints, matches and sparse models as tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofuse.plans.components import components
from geofuse.plans.rank import nth_smallest, ranked
from geofuse.plans.shared import attach, salt_bit, salt_of, stored
from geofuse.plans.stencil import beside, stencil

c = F.col
#: Keypoints of a frame that are packed together and compared at once.
BLOCK = 4096
#: Keypoints of a block that are set against the other block at a time.
STRIP = 64


def pack_bits(bits: DataFrame) -> DataFrame:
    """(frame_id, kp_id, bit, v) -> one 64-bit descriptor a keypoint."""
    return bits.groupBy("frame_id", "kp_id").agg(F.sum(F.call_function("shiftleft", c("v").cast("long"), c("bit").cast("int"))).alias("desc"))


def match_descriptors(kps: DataFrame, pairs: DataFrame, ratio: float = 0.8, max_distance: int = 64, cross_check: bool = True, block: int = BLOCK) -> DataFrame:
    """Best matches (fa, fb, i, j, d) of the keypoints of frame pairs by Hamming distance.

    The best must be near enough, and clearly better than the second; with cross_check it must be best both
    ways. Of equals the lowest id is best. Keypoints without a descriptor take no part.

    Descriptors are packed, block keypoints of a frame to a row. Each pair of blocks of a pair of frames is compared in one kernel,
    which gives two candidates a keypoint and way; what is shuffled are packed blocks and those, never a row for each pair of
    keypoints. A frame may have any number of keypoints.
    """
    rows = ranked(kps.filter("desc IS NOT NULL").select("frame_id", "kp_id", "desc"), ["frame_id"], ["kp_id"])
    part = F.floor(c("rank") / block).cast("int")
    packed = rows.groupBy("frame_id", part.alias("part"), F.ceil(c("__n") / block).cast("int").alias("parts")).agg(F.collect_list(F.struct("kp_id", "desc")).alias("k"))
    packed = stored(packed.select("frame_id", "part", "parts", c("k.kp_id").alias("ids"), c("k.desc").alias("desc")), "packed-descriptors")
    for frame, own in (("fa", "pa"), ("fb", "pb")):
        parts = packed.filter("part = 0").select(c("frame_id").alias(frame), F.sequence(F.lit(0), c("parts") - 1).alias("_n"))
        pairs = pairs.join(parts, frame).withColumn(own, F.explode("_n")).drop("_n")
    pairs = pairs.select("fa", "fb", "pa", "pb")
    key = F.struct("fa", "fb", "pa", "pb")
    a = packed.select(c("frame_id").alias("fa"), c("part").alias("pa"), "ids", "desc").join(pairs, ["fa", "pa"]).select(key.alias("a"), "ids", "desc")
    b = packed.select(c("frame_id").alias("fb"), c("part").alias("pb"), c("ids").alias("ids_b"), c("desc").alias("desc_b")).join(pairs, ["fb", "pb"]).select(key.alias("b"), "ids_b", "desc_b")
    frame, kp = (kps.schema[k].dataType.simpleString() for k in ("frame_id", "kp_id"))
    met = a.groupBy("a").cogroup(b.groupBy("b")).applyInArrow(_compared, f"fa {frame}, fb {frame}, own {kp}, other {kp}, d int, back boolean")
    place = Window.partitionBy("fa", "fb", "back", "own").orderBy("d", "other")
    two = met.withColumn("k", F.row_number().over(place)).filter("k <= 2")
    best = two.groupBy("fa", "fb", "back", "own").agg(F.min(F.struct("d", "other")).alias("m"), F.max(F.when(c("k") == 2, c("d"))).alias("d2")).select("fa", "fb", "back", "own", "m.other", "m.d", "d2")
    clear = (c("d") <= max_distance) & (c("d2").isNull() | (c("d") <= ratio * c("d2")))
    if not cross_check:
        return best.filter(~c("back") & clear).select("fa", "fb", c("own").alias("i"), c("other").alias("j"), "d")
    # Both ways of a match come together: the way there has to be clear, the way back only best.
    ends = F.when(c("back"), c("other")).otherwise(c("own")).alias("i"), F.when(c("back"), c("own")).otherwise(c("other")).alias("j")
    both = best.filter(c("back") | clear).groupBy("fa", "fb", *ends).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
    return both.filter("n = 2").select("fa", "fb", "i", "j", "d")


def _least_two(near: np.ndarray, axis: int) -> np.ndarray:
    """The two least of each row (axis 1) or column (axis 0); the greatest number stands for none."""
    out = []
    for _ in range(2):
        at = np.expand_dims(near.argmin(axis), axis)
        out.append(np.take_along_axis(near, at, axis).squeeze(axis))
        np.put_along_axis(near, at, np.iinfo(near.dtype).max, axis)
    return np.stack(out)


def _compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """The two nearest keypoints of the other block, for each of either block; of equals the lower id."""
    if not (left.num_rows and right.num_rows):
        out = [np.zeros(0, "int64")] * 4
        key = {"fa": None, "fb": None}
    else:
        key = left["a"][0].as_py()
        sides = []
        for t, ids, desc in ((left, "ids", "desc"), (right, "ids_b", "desc_b")):
            own = t[ids][0].values.to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            sides.append((own[order], t[desc][0].values.to_numpy(zero_copy_only=False)[order].view("uint64")))
        (own, left_bits), (other, right_bits) = sides
        # A distance and a place in one number, the lower the better; strip by strip, so that no table of all distances is held.
        n, m = len(own), len(other)
        kind = np.int32 if 65 * max(n, m) < 1 << 31 else np.int64
        none = np.iinfo(kind).max
        there, back = np.full((2, n), none, kind), np.full((2, m), none, kind)
        for at in range(0, n, STRIP):
            d = np.bitwise_count(left_bits[at : at + STRIP, None] ^ right_bits[None, :]).astype(kind)
            there[:, at : at + STRIP] = _least_two(d * m + np.arange(m, dtype=kind), 1)
            up = _least_two(d * n + np.arange(at, at + len(d), dtype=kind)[:, None], 0)
            back = np.sort(np.concatenate([back, up]), axis=0)[:2]
        found = []
        for ids, others, near, way in ((own, other, there, False), (other, own, back, True)):
            for key_ in near[: min(2, len(others))]:
                found.append((ids, others[key_ % len(others)], key_ // len(others), np.full(len(ids), way)))
        out = [np.concatenate(x) for x in zip(*found)]
    n = len(out[0])
    return pa.table({"fa": [key["fa"]] * n, "fb": [key["fb"]] * n, "own": out[0], "other": out[1], "d": out[2].astype("int32"), "back": out[3].astype(bool)})


def pair_displacement(matches: DataFrame, kps: DataFrame) -> DataFrame:
    """Per frame pair the upper median shift in pixels, the number of matches, and whether it may seed a model."""
    a = kps.select(c("kp_id").alias("i"), c("x").alias("ax"), c("y").alias("ay"))
    b = kps.select(c("kp_id").alias("j"), c("x").alias("bx"), c("y").alias("by"))
    m = matches.join(a, "i").join(b, "j").withColumn("shift", F.hypot(c("ax") - c("bx"), c("ay") - c("by")))
    s = m.groupBy("fa", "fb").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY shift DESC)").alias("median_px"), F.count(F.lit(1)).alias("matches"))
    return s.withColumn("seed", (c("matches") >= 60) & (c("median_px") >= 4))


def build_tracks(matches: DataFrame, frames: DataFrame) -> DataFrame:
    """Tracks (track_id, frame_id, kp_id): components of the matches that have one keypoint to a frame."""
    comp = components(matches.select(c("i").alias("a"), c("j").alias("b")))
    t = comp.select(c("node").alias("kp_id"), c("root").alias("track_id")).join(frames.select("kp_id", "frame_id"), "kp_id")
    per = t.groupBy("track_id", "frame_id").agg(F.count(F.lit(1)).alias("n")).groupBy("track_id").agg(F.max("n").alias("most"))
    return t.join(per.filter("most = 1"), "track_id").select("track_id", "frame_id", "kp_id")


def sharpness(pixels: DataFrame) -> DataFrame:
    """Per image the variance of the 4-neighbour Laplacian over interior pixels; -1 without any."""
    p = pixels.select("image_id", c("y").alias("row"), c("x").alias("col"), "g")
    lap = sum((beside(["image_id"], axis, step, "g") for axis in ("row", "col") for step in (1, -1)), -4 * c("g"))
    v = p.withColumn("lap", lap).groupBy("image_id").agg((F.avg(c("lap") * c("lap")) - F.avg("lap") * F.avg("lap")).alias("score"))
    return v.withColumn("score", F.coalesce("score", F.lit(-1.0)))


def reject_blurriest(frames: DataFrame, fraction: float, by: str = "capture") -> DataFrame:
    """Readable frames without the blurriest share of each capture; three at least stay."""
    ok = frames.filter("score >= 0")
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    drop = F.least(F.floor(n * fraction), F.greatest(n - 3, F.lit(0)))
    place = F.row_number().over(Window.partitionBy(by).orderBy("score", "image_id"))
    return ok.withColumns({"__drop": drop, "__k": place}).filter("__k > __drop").drop("__drop", "__k")


def even_subsample(frames: DataFrame, keep: int, by: str = "capture", order: str = "image_id") -> DataFrame:
    """keep rows of each group, evenly by order; all where there are no more."""
    keep = max(keep, 3)
    w = Window.partitionBy(by)
    f = frames.withColumns({"__n": F.count(F.lit(1)).over(w), "__i": F.row_number().over(w.orderBy(order)) - 1})
    ks = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda k: F.floor(k * (c("__n") - 1) / (keep - 1) + 0.5))
    return f.filter((c("__n") <= keep) | F.array_contains(ks, c("__i").cast("long"))).drop("__n", "__i")


def gating_report(frames: DataFrame, fraction: float, keep: int, by: str = "capture") -> DataFrame:
    kept = even_subsample(reject_blurriest(frames, fraction, by), keep, by).groupBy(by).agg(F.count(F.lit(1)).alias("kept"))
    n = frames.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(c("score") < 0).alias("unreadable"))
    valid = c("total") - c("unreadable")
    rejected = F.least(F.floor(valid * fraction), F.greatest(valid - 3, F.lit(0)))
    return n.join(kept, by, "left").select(by, "total", "unreadable", rejected.alias("blur_rejected"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def sequential(names: DataFrame, by: str = "capture") -> DataFrame:
    """Per capture whether names count up in small steps: 8 names, three quarters with 3 digits, over 70 % of gaps 1 to 5."""
    digits = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "[^0-9]", "")
    n = names.withColumn("num", F.when(F.length(digits) >= 3, digits.cast("long")))
    nums = n.filter("num IS NOT NULL").withColumn("gap", c("num") - F.lag("num").over(Window.partitionBy(by).orderBy("name")))
    g = nums.groupBy(by).agg(F.count(F.lit(1)).alias("numbered"), F.count_if(c("gap").between(1, 5)).alias("small"))
    total = n.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    ok = (c("n") >= 8) & (c("numbered") >= F.floor(c("n") * 3 / 4)) & (c("small") > (c("numbered") - 1) * 0.7)
    return total.join(g, by, "left").select(by, "n", F.coalesce(ok, F.lit(False)).alias("sequential"))


def capture_profile(gps: Column, fisheye: Column, dynamic: Column, aerial: Column, seq: Column, n: Column) -> Column:
    large = n >= 400
    return (
        F.when(gps, "gps-rtk-drone").when(fisheye, "fisheye-or-rolling-shutter").when(dynamic, "dynamic-scene").when(large & (aerial | ~seq), "large-scene")
        .when(seq & (n >= 120), "long-video").when(large, "large-scene").when(seq & (n >= 40), "ordered-video").otherwise("unordered-photos")
    )


def grid_spread(kps: DataFrame, width: int, height: int, target: int) -> DataFrame:
    """Per frame the best keypoint of each grid cell, then the strongest others up to target; all where there are no more."""
    rows = max(1, math.ceil(math.sqrt(target / (width / height))))
    cols = max(1, math.ceil(target / rows))
    col, row = F.least(F.floor(c("x") / max(width / cols, 1.0)), F.lit(cols - 1)), F.least(F.floor(c("y") / max(height / rows, 1.0)), F.lit(rows - 1))
    order = [c("score").desc(), c("kp_id")]
    place = lambda *by: F.row_number().over(Window.partitionBy("frame_id", *by).orderBy(*order))
    k = kps.withColumns({"__cell": row * cols + col, "__salt": salt_of("kp_id")})
    # What a salt of a frame can't tell from the frame's own: the best of each cell, and as many of the strongest as cells and target.
    k = k.withColumns({"__best": place("__salt", "__cell"), "__k": place("__salt")}).filter((c("__best") == 1) | (c("__k") <= target + rows * cols))
    k = k.withColumn("__best", place("__cell"))
    k = k.withColumn("__k", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.when(c("__best") == 1, 0).otherwise(1), *order)))
    return k.filter((c("__best") == 1) | (c("__k") <= target)).drop("__salt", "__cell", "__best", "__k")


def nms(pixels: DataFrame) -> DataFrame:
    """Pixels no neighbour of which is greater."""
    p = pixels.select("image_id", c("y").alias("row"), c("x").alias("col"), "g")
    return stencil(p, ["image_id"], "g", 1, "max", "top").filter("g >= top").select("image_id", c("row").alias("y"), c("col").alias("x"), "g")


def reference_pairs(images: DataFrame, fraction: float, k: int, by: str = "capture") -> DataFrame:
    """Per capture unordered pairs of every so many-th image with its k neighbours on each side."""
    w = Window.partitionBy(by)
    i = images.withColumns({"i": F.row_number().over(w.orderBy("image_id")) - 1, "n": F.count(F.lit(1)).over(w)})
    refs = F.greatest(F.lit(1), F.ceil(c("n") * max(0.05, min(1.0, fraction))))
    step = F.greatest(F.lit(1), F.floor(c("n") / refs))
    r = i.filter((c("i") % step == 0) & (F.floor(c("i") / step) < refs)).withColumn("j", F.explode(F.sequence(c("i") - k, c("i") + k))).filter("j >= 0 AND j < n AND j <> i")
    return r.select(by, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def nearest_refs(images: DataFrame, registered: DataFrame, k: int = 3, by: str = "capture") -> DataFrame:
    """Of each image the k registered ones nearest in the order of the capture, the earlier of equally near ones first.

    Only the k before and the k after can be among them: places among the registered come from a running count,
    and meet by place.
    """
    w = Window.partitionBy(by).orderBy("image_id")
    i = images.select(by, "image_id").withColumn("i", F.row_number().over(w))
    reg = i.join(registered.select(by, "image_id"), [by, "image_id"], "left_semi").withColumn("r", F.row_number().over(w)).select(by, c("image_id").alias("ref"), c("i").alias("ri"), "r")
    upto = i.join(reg.select(by, c("ref").alias("image_id"), F.lit(1).alias("one")), [by, "image_id"], "left").withColumn("r", F.sum(F.coalesce("one", F.lit(0))).over(w))
    near = upto.select(by, "image_id", "i", F.explode(F.sequence(c("r") - k, c("r") + k)).alias("r")).join(reg, [by, "r"]).filter("ref <> image_id")
    best = Window.partitionBy(by, "image_id").orderBy(F.abs(c("ri") - c("i")), "ri")
    return near.withColumn("k", F.row_number().over(best)).filter(c("k") <= k).select(by, "image_id", "ref", "k")


def hypothesis_scores(obs: DataFrame, expected: int) -> DataFrame:
    """Per solver the quality of its model: obs has solver, image_id, point_id, err_px. Gates and composite included."""
    # What observations come from runs once, and points are made once, however many rounds the median takes.
    obs = stored(obs.select("solver", "image_id", "point_id", "err_px"), "observations")
    # Rounded, so that a mean on the gate doesn't hang on the order of the sum.
    points = stored(obs.groupBy("solver", "point_id").agg(F.round(F.avg("err_px"), 9).alias("err"), F.count(F.lit(1)).alias("track")), "scored-points")
    p = points.groupBy("solver").agg(F.avg("track").alias("mean_track"), (F.count_if((c("track") >= 2) & (c("err") <= 4)) / F.count(F.lit(1))).alias("good"))
    # The upper median is found by counting: no task holds the errors of a whole model.
    median = nth_smallest(points, "err", F.floor(c("n") / 2), ["solver"]).withColumnRenamed("err", "median_err")
    p = p.join(median, "solver")
    i = obs.groupBy("solver").agg(F.countDistinct("image_id").alias("images"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    s = p.join(i, "solver").withColumn("registered", unit(c("images") / F.greatest(F.lit(expected), c("images"))))
    s = s.withColumn("loop", unit(c("registered") * unit(c("mean_track") / 4)))
    value = 0.30 * c("registered") + 0.22 * (1 - unit(c("median_err") / 8)) + 0.18 * unit(c("mean_track") / 6) + 0.18 * c("good") + 0.12 * c("loop")
    s = s.withColumn("composite", value)
    ok = (c("registered") >= 0.35) & (c("median_err") <= 6) & (c("mean_track") >= 1.5) & (c("good") >= 0.25) & (c("composite") >= 0.28)
    return s.withColumn("passes", ok)


def prune_obs(obs: DataFrame, threshold: float) -> DataFrame:
    """Observations under the threshold of points that keep two of them."""
    near = obs.filter(c("err_px") < threshold)
    two = near.groupBy("solver", "point_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return near.join(two, ["solver", "point_id"], "left_semi")


# Meshes ---------------------------------------------------------------------------------------------------------


def mesh_components(triangles: DataFrame) -> DataFrame:
    """(tri_id, component, size): triangles that share vertices; size in triangles. Links go from vertex to vertex."""
    links = triangles.select(c("v0").alias("a"), c("v1").alias("b")).unionByName(triangles.select(c("v0").alias("a"), c("v2").alias("b")))
    comp = components(links.filter("a <> b"))
    t = triangles.join(comp.select(c("node").alias("v0"), "root"), "v0", "left").withColumn("component", F.coalesce("root", "v0"))
    t = stored(t.select("tri_id", "component", salt_of("tri_id").alias("salt")), "mesh-triangles")
    # A mesh is mostly one component: its triangles are spread over salts.
    size = t.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.bit_or(salt_bit(c("salt"))).alias("salts"))
    return attach(t, size, ["component"]).select("tri_id", "component", "size")


def keep_large(triangles: DataFrame, fraction: float) -> DataFrame:
    t = stored(mesh_components(triangles), "mesh-components")
    most = t.agg(F.max("size")).first()[0] or 0
    return triangles.join(t.filter(c("size") >= max(1, math.ceil(fraction * most))), "tri_id", "left_semi")


def _corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    t = triangles
    for i in range(3):
        t = t.join(vertices.select(c("v").alias(f"v{i}"), *[c(k).alias(f"{k}{i}") for k in "xyz"]), f"v{i}")
    return t


def vertex_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per vertex the unit sum of its triangles' cross products; up where that has no length."""
    t = _corners(triangles, vertices)
    a, b = [[c(f"{k}{i}") - c(f"{k}0") for k in "xyz"] for i in (1, 2)]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    t = t.select(F.explode(F.array("v0", "v1", "v2")).alias("v"), *[e.alias(f"n{k}") for e, k in zip(n, "xyz")])
    s = t.groupBy("v").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    length = F.sqrt(c("nx") * c("nx") + c("ny") * c("ny") + c("nz") * c("nz"))
    ok = length > 1e-12
    return s.select("v", *[F.when(ok, c(f"n{k}") / length).otherwise(1.0 if k == "z" else 0.0).alias(f"n{k}") for k in "xyz"])


def laplacian_smooth(triangles: DataFrame, vertices: DataFrame, lam: float) -> DataFrame:
    """Vertices moved a share of the way to the mean of their distinct neighbours."""
    e = None
    for i, j in ((0, 1), (1, 2), (2, 0)):
        for p, q in ((i, j), (j, i)):
            part = triangles.select(c(f"v{p}").alias("v"), c(f"v{q}").alias("o"))
            e = part if e is None else e.unionByName(part)
    e = e.filter("v <> o").distinct().join(vertices.select(c("v").alias("o"), *[c(k).alias(f"o{k}") for k in "xyz"]), "o")
    m = e.groupBy("v").agg(*[F.avg(f"o{k}").alias(f"m{k}") for k in "xyz"])
    return vertices.join(m, "v", "left").select("v", *[F.coalesce(c(k) + lam * (c(f"m{k}") - c(k)), c(k)).alias(k) for k in "xyz"])


def compact_vertices(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Used vertices with dense new numbers in id order: counts per range, then places within."""
    used = triangles.select(F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct()
    kept = stored(vertices.join(used, "v", "left_semi").repartitionByRange("v").withColumn("part", F.spark_partition_id()), "mesh-vertices")
    counts = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1
    return kept.withColumn("place", place).join(counts, "part").select("v", (c("offset") + c("place")).alias("new_v"))

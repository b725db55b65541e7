"""Grouped geometry: batches of small solves that Spark keys and spreads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofuse.plans.shared import few, stored

c = F.col


def triangulate(matches: DataFrame, poses: DataFrame) -> DataFrame:
    """Points of calibrated matches (pair_id, fa, fb, x1, y1, x2, y2) between posed frames, by the linear null vector.

    poses has frame_id, qw..qz, tx..tz. Directions at infinity give no row, nor do points on the line through both cameras: their
    rays coincide, so that a whole line fits them. Adds wx wy wz and the depths d1 d2.
    """
    cols = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    a = poses.select(c("frame_id").alias("fa"), *[c(k).cast("double").alias(f"a_{k}") for k in cols])
    b = poses.select(c("frame_id").alias("fb"), *[c(k).cast("double").alias(f"b_{k}") for k in cols])
    met = matches.join(a, "fa").join(b, "fb")

    def matrices(pdf: pd.DataFrame, side: str) -> np.ndarray:
        w, x, y, z, tx, ty, tz = (pdf[f"{side}_{k}"].to_numpy() for k in cols)
        m = np.empty((len(pdf), 3, 4))
        m[:, 0] = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), tx], 1)
        m[:, 1] = np.stack([2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), ty], 1)
        m[:, 2] = np.stack([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y), tz], 1)
        return m

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            pa, pb = matrices(pdf, "a"), matrices(pdf, "b")
            x1, y1, x2, y2 = (pdf[k].to_numpy()[:, None] for k in ("x1", "y1", "x2", "y2"))
            rows = np.stack([x1 * pa[:, 2] - pa[:, 0], y1 * pa[:, 2] - pa[:, 1], x2 * pb[:, 2] - pb[:, 0], y2 * pb[:, 2] - pb[:, 1]], 1)
            _, size, v = np.linalg.svd(rows)
            v = v[:, 3]
            ok = (np.abs(v[:, 3]) > 1e-12) & (size[:, 2] > 1e-12 * size[:, 0])
            p = v[ok, :3] / v[ok, 3:]
            h = np.concatenate([p, np.ones((len(p), 1))], 1)
            out = pdf.loc[ok, ["pair_id", "fa", "fb", "x1", "y1", "x2", "y2"]].copy()
            out[["wx", "wy", "wz"]] = p
            out["d1"], out["d2"] = np.einsum("ni,ni->n", pa[ok, 2], h), np.einsum("ni,ni->n", pb[ok, 2], h)
            yield out

    return met.mapInPandas(solve, "pair_id long, fa long, fb long, x1 double, y1 double, x2 double, y2 double, wx double, wy double, wz double, d1 double, d2 double")


def two_view_verify(matches: DataFrame, focal: float, iterations: int = 400, least: int = 12) -> DataFrame:
    """Per frame pair an essential matrix by 8-point RANSAC: pair of frames, matches, inliers, e00..e22; a pair without a model has none.

    Draws come from the POOL different matches of a pair whose hash is least, so that reruns agree; every match is scored. A pair
    of any number of matches is scored in pieces of about PIECE different ones, each with the number of its repeats, and its
    inliers are fitted by the triangular factors of the pieces. Matches without finite coordinates count, and are never inliers.
    """
    limit, at, pair = (2.5 / focal) ** 2, ["x1", "y1", "x2", "y2"], ["fa", "fb"]
    nine = "array<double>"
    rows = matches.select("fa", "fb", *[c(k).cast("double").alias(k) for k in at])
    usable = F.forall(F.array(*at), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    apart = stored(rows.groupBy(*pair, *at).agg(F.count(F.lit(1)).alias("w")).withColumn("h", F.xxhash64(*at)), "matches")
    sizes = apart.groupBy(*pair).agg(F.sum("w").alias("matches"), F.count_if(usable).alias("different"))
    sizes = sizes.withColumn("pieces", F.ceil(c("different") / PIECE).cast("long"))
    fit = sizes.filter((c("matches") >= max(8, least)) & (c("different") >= 8))
    pieces = apart.filter(usable).join(fit.select(*pair, "pieces"), pair).withColumn("piece", F.pmod("h", "pieces")).drop("pieces")
    first = F.row_number().over(Window.partitionBy(*pair).orderBy("h", *at))
    pool = apart.filter(usable).withColumn("k", first).filter(c("k") <= POOL).join(fit.select(*pair), pair, "left_semi")

    def rows_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.stack([q[..., 0] * p[..., 0], q[..., 0] * p[..., 1], q[..., 0], q[..., 1] * p[..., 0], q[..., 1] * p[..., 1], q[..., 1], p[..., 0], p[..., 1], np.ones(p.shape[:-1])], -1)

    def eight(a: np.ndarray) -> np.ndarray:
        e = np.linalg.svd(a, full_matrices=True)[2][..., -1, :].reshape(*a.shape[:-2], 3, 3)
        u, s, vt = np.linalg.svd(e)
        mean = (s[..., 0] + s[..., 1]) / 2
        d = np.zeros_like(e)
        d[..., 0, 0] = d[..., 1, 1] = mean
        return u @ d @ vt

    def inside(e: np.ndarray, pdf: pd.DataFrame):
        """Which of some matches at once are within the limit of each model."""
        step = max(256, (1 << 20) // len(e))
        for i in range(0, len(pdf), step):
            part = pdf.iloc[i : i + step]
            hp, hq = (np.column_stack([part[list(k)].to_numpy(), np.ones(len(part))]) for k in (("x1", "y1"), ("x2", "y2")))
            ep, eq = (hp @ e[:, j, :].T for j in range(3)), (hq @ e[:, :, j].T for j in range(2))
            e0, e1, e2 = ep
            f0, f1 = eq
            top = (e0 * hq[:, :1] + e1 * hq[:, 1:2] + e2) ** 2
            yield part, top / np.maximum(e0**2 + e1**2 + f0**2 + f1**2, 1e-18) < limit

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        rng = np.random.default_rng([int(key[0]), int(key[1])])
        picks = np.argsort(rng.random((iterations, len(pdf))), axis=1)[:, :8]
        e = eight(rows_of(pdf[["x1", "y1"]].to_numpy()[picks], pdf[["x2", "y2"]].to_numpy()[picks]))
        return pd.DataFrame([[key[0], key[1], e.ravel()]], columns=["fa", "fb", "e"])

    def score(key: tuple, pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        e, hits = np.array(model["e"].iloc[0]).reshape(-1, 3, 3), 0
        for part, ok in inside(e, pdf):
            hits = hits + part["w"].to_numpy() @ ok
        return pd.DataFrame({"fa": key[0], "fb": key[1], "k": np.arange(len(e)), "hits": hits})

    def factor(key: tuple, pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        e, r = np.array(model["e"].iloc[0]).reshape(1, 3, 3), np.zeros((0, 9))
        for part, ok in inside(e, pdf):
            own = part[ok[:, 0]]
            a = rows_of(own[["x1", "y1"]].to_numpy(), own[["x2", "y2"]].to_numpy()) * np.sqrt(own["w"].to_numpy())[:, None]
            r = np.linalg.qr(np.concatenate([r, a]), mode="r")
        return pd.DataFrame([[key[0], key[1], key[2], r.ravel()]], columns=["fa", "fb", "piece", "r"])

    def refit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.concatenate([np.array(v).reshape(-1, 9) for v in pdf.sort_values("piece")["r"]])
        return pd.DataFrame([[key[0], key[1], eight(np.linalg.qr(a, mode="r")).ravel()]], columns=["fa", "fb", "e"])

    def over_pieces(models: DataFrame, how, schema: str) -> DataFrame:
        sent = models.join(fit.select(*pair, "pieces"), pair).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), c("pieces") - 1))).drop("pieces")
        return pieces.groupBy(*pair, "piece").cogroup(sent.groupBy(*pair, "piece")).applyInPandas(_both(how), schema)

    drawn = stored(pool.groupBy(*pair).applyInPandas(draw, f"fa long, fb long, e {nine}"), "drawn")
    hits = over_pieces(drawn, score, "fa long, fb long, k long, hits long").groupBy(*pair, "k").agg(F.sum("hits").alias("hits"))
    best = hits.groupBy(*pair).agg(F.max(F.struct("hits", (-c("k")).alias("k"))).alias("b")).select(*pair, c("b.hits").alias("hits"), (-c("b.k")).alias("k"))
    best = best.filter(c("hits") >= least).join(drawn, pair)
    best = stored(best.select(*pair, "hits", F.slice("e", (c("k") * 9 + 1).cast("int"), F.lit(9)).alias("e")), "best")
    again = over_pieces(best.select(*pair, "e"), factor, f"fa long, fb long, piece long, r {nine}")
    again = stored(again.groupBy(*pair).applyInPandas(refit, f"fa long, fb long, e {nine}"), "again")
    kept = over_pieces(again, score, "fa long, fb long, k long, hits long").groupBy(*pair).agg(F.sum("hits").alias("hits2"))
    better = c("hits2") >= c("hits")
    known = best.join(again.withColumnRenamed("e", "e2"), pair).join(kept, pair)
    known = known.select(*pair, F.when(better, c("hits2")).otherwise(c("hits")).alias("inliers"), F.when(better, c("e2")).otherwise(c("e")).alias("e"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda t, v: t + v * v))
    out = sizes.join(known, pair, "left")
    return out.select(*[c(k).cast("long").alias(k) for k in pair], "matches", F.coalesce("inliers", F.lit(0).cast("long")).alias("inliers"), *[(c("e")[i] / size).alias(k) for i, k in enumerate(NAMES)])


#: Different matches that draws are made from, eight for each of 400; different matches that are scored at once.
POOL, PIECE = 3200, 1 << 16


def _both(how):
    """A function of a piece and its model that is left out where either is missing: hashes needn't fill every piece."""

    def call(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame | None:
        return how(key, left, right) if len(left) and len(right) else pd.DataFrame()

    return call


NAMES = [f"e{i}{j}" for i in range(3) for j in range(3)]


def good_points(points: DataFrame, poses: DataFrame, least_degrees: float = 1.0) -> DataFrame:
    """Triangulated points before both cameras whose rays meet at an angle that is wide enough."""
    from geofuse.functions.camera import centre, parallax

    q = lambda s: tuple(c(f"{s}_{k}") for k in ("qw", "qx", "qy", "qz"))
    t = lambda s: tuple(c(f"{s}_{k}") for k in ("tx", "ty", "tz"))
    cols = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    for side, frame in (("a", "fa"), ("b", "fb")):
        points = points.join(poses.select(c("frame_id").alias(frame), *[c(k).cast("double").alias(f"{side}_{k}") for k in cols]), frame)
    angle = F.degrees(parallax(tuple(centre(q("a"), t("a"))), tuple(centre(q("b"), t("b"))), (c("wx"), c("wy"), c("wz"))))
    near = points.withColumn("angle", angle).filter((c("d1") > 0) & (c("d2") > 0) & (c("angle") >= least_degrees))
    return near.drop(*[f"{s}_{k}" for s in "ab" for k in cols])


def densify_matches(bags: DataFrame, poses: DataFrame, focal: float, least: int = 32) -> DataFrame:
    """Points of dense matches with a certainty: over 0.5, seen 2 px from where they should be or nearer in both
    frames, rays 1 to 35 degrees apart; pairs of frames that keep fewer than least points are left out."""
    from geofuse.functions.camera import world_to_cam

    points = good_points(triangulate(bags.filter(c("certainty") > 0.5), poses), poses).filter("angle <= 35")
    for side, frame in (("1", "fa"), ("2", "fb")):
        pose = poses.select(c("frame_id").alias(frame), *[c(k).cast("double").alias(f"p_{k}") for k in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
        at = points.join(pose, frame)
        x, y, z = world_to_cam(tuple(c(f"p_{k}") for k in ("qw", "qx", "qy", "qz")), tuple(c(f"p_{k}") for k in ("tx", "ty", "tz")), (c("wx"), c("wy"), c("wz")))
        off = F.hypot(x / z - c(f"x{side}"), y / z - c(f"y{side}")) * focal
        points = at.filter(off <= 2).drop(*[f"p_{k}" for k in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
    enough = points.groupBy("fa", "fb").agg(F.count(F.lit(1)).alias("n")).filter(c("n") >= least)
    return points.join(enough, ["fa", "fb"], "left_semi")


def first_matches(matches: DataFrame) -> DataFrame:
    """(ref_frame, track_id, kp_id) matches with one to a keypoint and one to a track: the first by frame, keypoint, track."""
    w = lambda k: Window.partitionBy(k).orderBy("ref_frame", "kp_id", "track_id")
    once = matches.withColumn("__k", F.row_number().over(w("kp_id"))).filter("__k = 1")
    return once.withColumn("__t", F.row_number().over(w("track_id"))).filter("__t = 1").drop("__k", "__t")


def ground_plane(points: DataFrame, key: str, tries: int = 256, sample: int = 4000, least: float = 0.2) -> DataFrame:
    """The plane that most of a bounded sample lies on, its normal toward the rest: nx ny nz, share; no row without a credible one.

    Triples come from the sample of least hash, paired by rank, so that reruns agree; sample bounds what is sent
    to every task. The tolerance is a hundredth of the radius that holds nine tenths of all points.
    """
    from geofuse.operators.cloud import robust_radius

    ball = robust_radius(points.withColumn("all", F.lit(0)), ["all"], 0.9).first()
    if ball is None:
        return points.sparkSession.createDataFrame([], "nx double, ny double, nz double, share double")
    s = points.orderBy(F.xxhash64(key), key).limit(sample).select("x", "y", "z").toPandas().to_numpy()
    rng = np.random.default_rng(29)
    if len(s) < 32:
        return points.sparkSession.createDataFrame([], "nx double, ny double, nz double, share double")
    t = s[np.stack([rng.choice(len(s), 3, replace=False) for _ in range(tries)])]
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    size = np.linalg.norm(n, axis=1)
    n, d = n[size > 1e-9] / size[size > 1e-9, None], None
    d = np.einsum("ni,ni->n", n, t[size > 1e-9, 0])
    planes = points.sparkSession.createDataFrame(pd.DataFrame({"i": range(len(n)), "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "d": d}))
    away = c("nx") * c("x") + c("ny") * c("y") + c("nz") * c("z") - c("d")
    # tries planes (the bound) go to every task; the counting is over all points, added up map-side
    hits = points.select("x", "y", "z").join(F.broadcast(planes)).groupBy("i", "nx", "ny", "nz", "d").agg(
        F.count_if(F.abs(away) < 0.01 * ball["radius"]).alias("hits"), F.count(F.lit(1)).alias("n"), F.avg(away).alias("mean"), F.min(away).alias("lowest")
    )
    best = hits.orderBy(c("hits").desc(), "i").limit(1).filter(c("hits") >= least * c("n"))
    sign = F.when(c("mean") < 0, -1.0).otherwise(1.0)
    return best.select((c("nx") * sign).alias("nx"), (c("ny") * sign).alias("ny"), (c("nz") * sign).alias("nz"), (c("hits") / c("n")).alias("share"))


def tsdf_fuse(voxels: DataFrame, depth: DataFrame, views: DataFrame, trunc: float, least_cos: float = 0.2, colours: tuple[str, ...] = ()) -> DataFrame:
    """Per voxel the cosine-weighted mean of the clamped distances that views measured: (vx, vy, vz) -> sdf, weight, colours.

    voxels has its indices and centre x y z; depth has image_id, py, px, depth, cos and the columns colours. views is broadcast
    (cameras of one model, whose number is checked). Voxels that no view measured are absent. A voxel's colours are the cosine-weighted
    mean of the pixels that measured it nearer than trunc: farther ones show what stands before or behind it.
    Without such a pixel they are 0.
    """
    from geofuse.functions.camera import project, world_to_cam

    v = views.select("image_id", "f", "width", "height", *[c(k).alias(f"v_{k}") for k in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
    both = voxels.join(few(v, what="views"))
    p = world_to_cam((c("v_qw"), c("v_qx"), c("v_qy"), c("v_qz")), (c("v_tx"), c("v_ty"), c("v_tz")), (c("x"), c("y"), c("z")))
    both = both.withColumns({"cx": p[0], "cy": p[1], "cz": p[2]}).filter("cz > 1e-4")
    u, w = project([c("cx"), c("cy"), c("cz")], c("f"), c("width"), c("height"))
    hit = both.withColumns({"px": F.floor(u).cast("int"), "py": F.floor(w).cast("int")}).join(depth, ["image_id", "py", "px"])
    sdf = c("depth") - c("cz")
    seen = hit.filter((c("cos") >= least_cos) & (sdf >= -trunc) & (c("depth") > 0)).withColumn("sdf", F.least(sdf, F.lit(trunc)))
    close = F.when(F.abs("sdf") < trunc, c("cos"))
    tint = [F.coalesce(F.sum(close * c(k)) / F.sum(F.when(c(k).isNotNull(), close)), F.lit(0.0)).alias(k) for k in colours]
    return seen.groupBy("vx", "vy", "vz").agg((F.sum(c("sdf") * c("cos")) / F.sum("cos")).alias("sdf"), F.sum("cos").alias("weight"), *tint)

"""Telemetry and control points: origins, matched poses, similarity fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofuse.functions import geodesy as g
from geofuse.plans.asof import asof_nearest
from geofuse.plans.shared import salt_of, stored, with_groups


def track_origin(telemetry: DataFrame) -> DataFrame:
    """Per track the weighted mean position, its uncertainty and the number of fixes; one map-side combined aggregate."""
    w = g.cov_weight(F.col("std_e"), F.col("std_n"))
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    return telemetry.groupBy("track_id").agg(
        mean("lon_deg").alias("lon0"), mean("lat_deg").alias("lat0"), mean("height_m").alias("h0"),
        F.avg(F.greatest("std_e", "std_n")).alias("uncertainty_m"), F.count(F.lit(1)).alias("fixes"), F.lit("metric").alias("scale_status"),
    )


FIX = ["sample_id", "lon_deg", "lat_deg", "height_m", "std_e", "std_n", "std_u", "source"]


def match_frames(frames: DataFrame, telemetry: DataFrame, tolerance_s: float = 0.5) -> DataFrame:
    """Frames with the nearest fix of their track in time."""
    return asof_nearest(frames, telemetry, ["track_id"], "unix_s", "sample_id", FIX, tolerance_s)


def georeference(frames: DataFrame, telemetry: DataFrame, tolerance_s: float = 0.5) -> DataFrame:
    """Matched poses: geodetic, ECEF and ENU about the track's origin. All shuffles go by track_id."""
    posed = match_frames(frames, telemetry, tolerance_s).join(track_origin(telemetry), "track_id")
    x, y, z = g.geodetic_to_ecef(F.col("lon_deg"), F.col("lat_deg"), F.col("height_m"))
    e, n, u = g.ecef_to_enu(F.col("ecef_x"), F.col("ecef_y"), F.col("ecef_z"), F.col("lon0"), F.col("lat0"), F.col("h0"))
    return posed.withColumns({"ecef_x": x, "ecef_y": y, "ecef_z": z}).withColumns({"enu_e": e, "enu_n": n, "enu_u": u})


def fallback_poses(matched: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Per track without a matched frame, one pose per fix, named by its order."""
    lone = telemetry.join(matched.select("track_id").distinct(), "track_id", "left_anti")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("track_id").orderBy("unix_s", "sample_id")) - 1
    return lone.withColumn("name", F.format_string("telemetry_%05d", k))


def sim3_sums(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group the sums that a similarity between (lx, ly, lz) and (qx, qy, qz) needs: two aggregates.

    A group's means go to its pairs without a shuffle where groups are few, else by salts: no task gets a large group whole.
    """
    a, b = ("lx", "ly", "lz"), ("qx", "qy", "qz")
    means = pairs.groupBy(*by).agg(*[F.avg(c).alias(f"m_{c}") for c in (*a, *b)])
    d = with_groups(pairs.withColumn("salt", salt_of(*a, *b)), stored(means, "pair-means"), by).withColumns({f"d_{c}": F.col(c) - F.col(f"m_{c}") for c in (*a, *b)})
    square = lambda cs: sum((F.col(f"d_{c}") * F.col(f"d_{c}") for c in cs), F.lit(0.0))
    cross = [F.sum(F.col(f"d_{p}") * F.col(f"d_{q}")).alias(f"h_{p}_{q}") for p in a for q in b]
    return d.groupBy(*by, *[f"m_{c}" for c in (*a, *b)]).agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.sqrt(F.avg(square(a))), F.lit(1e-9)).alias("radius_l"),
        F.greatest(F.sqrt(F.avg(square(b))), F.lit(1e-9)).alias("radius_q"), *cross,
    )


def fit_sim3(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group scale, rotation (r00..r22) and translation; only sums of a group reach Python, a row each."""
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    sums = sim3_sums(pairs, by)
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in by)

    def finish(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            h = pdf[[f"h_{p}_{q}" for p in ("lx", "ly", "lz") for q in ("qx", "qy", "qz")]].to_numpy().reshape(-1, 3, 3)
            u, _, vt = np.linalg.svd(h)
            v, ut = np.swapaxes(vt, 1, 2), np.swapaxes(u, 1, 2)
            flip = np.broadcast_to(np.eye(3), h.shape).copy()
            flip[:, 2, 2] = np.sign(np.linalg.det(v @ ut))
            rot = v @ flip @ ut
            scale = (pdf["radius_q"] / pdf["radius_l"]).to_numpy()
            ml, mq = pdf[["m_lx", "m_ly", "m_lz"]].to_numpy(), pdf[["m_qx", "m_qy", "m_qz"]].to_numpy()
            t = mq - scale[:, None] * np.einsum("nij,nj->ni", rot, ml)
            out = pdf[by].copy()
            out["n"], out["scale"] = pdf["n"].to_numpy(), scale
            out[names] = rot.reshape(-1, 9)
            out[["tx", "ty", "tz"]] = t
            yield pd.DataFrame(out)

    return sums.mapInPandas(finish, f"{keys}, n long, scale double, {', '.join(f'{c} double' for c in names)}, tx double, ty double, tz double")


def gcp_residuals(pairs: DataFrame, fits: DataFrame, by: list[str], least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Per point its residual and whether it is an outlier; per group mean, max, rms and counts. Nothing is refitted."""
    p = [F.col(c) for c in ("lx", "ly", "lz")]
    moved = [F.col("scale") * sum((F.col(f"r{i}{j}") * p[j] for j in range(3)), F.lit(0.0)) + F.col(t) for i, t in enumerate(("tx", "ty", "tz"))]
    gap = sum(((m - F.col(q)) * (m - F.col(q)) for m, q in zip(moved, ("qx", "qy", "qz"))), F.lit(0.0))
    points = pairs.join(fits.filter(F.col("n") >= least), by).withColumn("residual", F.sqrt(gap))
    stats = points.groupBy(*by).agg(
        F.avg("residual").alias("mean_m"), F.max("residual").alias("max_m"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms_m"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY residual DESC)").alias("median_m"), F.count(F.lit(1)).alias("points"),
    )
    limit = F.greatest(3 * F.col("median_m"), F.lit(0.15), 2.5 * F.col("mean_m"))
    flagged = points.join(stats, by).withColumn("outlier", F.col("residual") > limit)
    return flagged.select(*by, "gcp_id", "residual", "outlier"), stats

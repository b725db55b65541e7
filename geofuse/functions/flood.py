"""Flood rules as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dry limit in metres, and the comparison tolerances.
H_DRY = 5e-4
TOLERANCE = {"mass": 0.15, "depth": 0.35, "wet": 0.12, "rmse": 0.4, "iou": 0.7}


def hazard_stats(depth: Column, speed: Column) -> Column:
    """The class of a whole state, by its greatest depth and speed."""
    score = depth * F.greatest(F.lit(1.0), speed)
    return F.when((score >= 1.8) | (depth >= 1.6), 3).when((score >= 0.9) | (depth >= 1.0), 2).when((score >= 0.25) | (depth >= 0.35), 1).otherwise(0)


def hazard_timeline(depth: Column, discharge: Column) -> Column:
    return F.when((depth >= 1.6) | (discharge >= 70), 3).when((depth >= 1.0) | (discharge >= 45), 2).when((depth >= 0.4) | (discharge >= 20), 1).otherwise(0)


def hazard_cell(depth: Column) -> Column:
    return F.when(depth >= 1.6, 3).when(depth >= 1.0, 2).when(depth >= 0.35, 1).otherwise(0)


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def depth_rgba(depth: Column, reference: Column, style: str) -> Column:
    """(r, g, b, a) of a depth in the style depth, hazard or contour; clear where dry."""

    def colour(*parts) -> Column:
        return F.struct(*[(p if isinstance(p, Column) else F.lit(p)).cast("int").alias(n) for p, n in zip(parts, "rgba")])

    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), depth / F.greatest(F.lit(0.15), reference)))
    if style == "hazard":
        h = hazard_cell(depth)
        wet = F.when(h == 3, colour(229, 93, 120, 210)).when(h == 2, colour(229, 93, 120, 170)).when(h == 1, colour(241, 184, 75, 140)).otherwise(colour(37, 198, 217, 90))
    elif style == "contour":
        wet = colour(37, 198, 217, _half_up(40 + t * 50))
    else:
        wet = colour(_half_up(37 - 29 * t), _half_up(198 - 180 * t * 0.55), _half_up(217 - 188 * t * 0.35), _half_up(55 + t * 160))
    return F.when(depth <= H_DRY, colour(0, 0, 0, 0)).otherwise(wet)


def status_label(intensity: Column) -> Column:
    return F.when(intensity < 0.15, "Dry / low water").when(intensity < 0.45, "Rising").when(intensity < 0.75, "Near peak").when(intensity < 0.92, "Peak / high water").otherwise("Receding")


def hand_stage(t01: Column, peak: float = 1.5) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t01))
    rise = F.sin(F.least(F.lit(1.0), t / 0.4) * (math.pi / 2))
    return F.lit(peak) * rise * F.when(t <= 0.4, F.lit(1.0)).otherwise(F.exp(-(t - 0.4) / 0.35))


def forcing(stage: Column, discharge: Column, peak: float = 2.35) -> dict[str, Column]:
    i = F.least(F.lit(1.4), stage / peak)
    return {"rain_mm_h": 2 + i * 38, "inflow_cms": F.greatest(F.lit(0.0), discharge * 0.35), "infiltration_mm_h": 1.5 + (1 - i) * 2}


def authority(mode: Column, validation: Column) -> Column:
    return F.coalesce((mode == "anuga") & validation.isin("calibrated", "validated"), F.lit(False))

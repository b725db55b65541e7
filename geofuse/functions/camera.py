"""Pinhole cameras as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geofuse.functions.splat import rotation


def world_to_cam(q: tuple[Column, ...], t: tuple[Column, ...], p: tuple[Column, ...]) -> list[Column]:
    m = rotation(*q)
    return [m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + t[i] for i in range(3)]


def centre(q: tuple[Column, ...], t: tuple[Column, ...]) -> list[Column]:
    m = rotation(*q)
    return [-(m[0][i] * t[0] + m[1][i] * t[1] + m[2][i] * t[2]) for i in range(3)]


def project(cam: list[Column], f: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Pixel of a point before the camera; null behind it."""
    ahead = cam[2] > 1e-6
    return F.when(ahead, f * cam[0] / cam[2] + width / 2), F.when(ahead, f * cam[1] / cam[2] + height / 2)


def sampson(e: list[list[Column]], x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """First-order distance of a pair of calibrated points to the epipolar constraint, squared."""
    a, b = (x1, y1, F.lit(1.0)), (x2, y2, F.lit(1.0))
    ea = [e[i][0] * a[0] + e[i][1] * a[1] + e[i][2] * a[2] for i in range(3)]
    eb = [e[0][i] * b[0] + e[1][i] * b[1] + e[2][i] * b[2] for i in range(3)]
    top = b[0] * ea[0] + b[1] * ea[1] + b[2] * ea[2]
    below = ea[0] * ea[0] + ea[1] * ea[1] + eb[0] * eb[0] + eb[1] * eb[1]
    return F.when(below > 0, top * top / below)


def parallax(c1: tuple[Column, ...], c2: tuple[Column, ...], p: tuple[Column, ...]) -> Column:
    """The angle between the rays from two centres to a point."""
    a, b = [x - y for x, y in zip(p, c1)], [x - y for x, y in zip(p, c2)]
    dot = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    na, nb = (F.sqrt(sum((x * x for x in v), F.lit(0.0))) for v in (a, b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (na * nb))))

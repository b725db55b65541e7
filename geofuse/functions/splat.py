"""Gaussian splats as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the constant of the first spherical harmonic.
SH_C0 = 0.28209479177387814


def opacity(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def unit_quaternion(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """Of length one; the identity where it has no length."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    degenerate = n < 1e-12
    return tuple(F.when(degenerate, F.lit(e)).otherwise(q / n) for q, e in ((w, 1.0), (x, 0.0), (y, 0.0), (z, 0.0)))


def rgb(*dc: Column) -> tuple[Column, ...]:
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (0.5 + SH_C0 * d) * 255)) for d in dc)


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """The row-major matrix of a unit quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def covariance(rot: list[list[Column]], scale: list[Column]) -> dict[str, Column]:
    """The upper triangle of R S S R'."""
    m = [[rot[i][j] * scale[j] for j in range(3)] for i in range(3)]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return {f"c{i}{j}": dot(m[i], m[j]) for i in range(3) for j in range(i, 3)}


def _round(x: Column) -> Column:
    """Half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def byte(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), _round(x))).cast("int")


def fixed24(x: Column, bits: int = 12) -> Column:
    """A coordinate in 24-bit two's complement with so many fractional bits."""
    return _round(x * (1 << bits)).cast("long").bitwiseAND(F.lit(0xFFFFFF)).cast("int")


def log_scale_byte(s: Column) -> Column:
    return byte((s + 10) * 16)


def colour_byte(dc: Column) -> Column:
    return byte(dc * (0.15 * 255) + 0.5 * 255)


def sh_byte(x: Column, bucket: int) -> Column:
    q = _round(x * 128).cast("int") + 128
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((q + bucket // 2) / bucket) * bucket)).cast("int")


def smallest_three(w: Column, x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Which part of a unit quaternion is largest (the first of equals), and the others in 10-bit signed steps."""
    q = (w, x, y, z)
    top = F.greatest(*[F.abs(v) for v in q])
    largest = F.when(F.abs(w) == top, 0).when(F.abs(x) == top, 1).when(F.abs(y) == top, 2).otherwise(3)
    sign = F.when(F.array(*q)[largest] < 0, -1.0).otherwise(1.0)
    step = lambda v: F.greatest(F.lit(-511), F.least(F.lit(511), _round(v * sign * (math.sqrt(2) * 511)))).cast("int")
    rest = F.array(*[F.struct(F.lit(i).alias("i"), step(v).alias("v")) for i, v in enumerate(q)])
    others = F.transform(F.filter(rest, lambda p: p["i"] != largest), lambda p: p["v"])
    return {"largest": largest, "qa": others[0], "qb": others[1], "qc": others[2]}


def axis_rotation(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    """A rotation matrix on the driver."""
    n = math.sqrt(sum(a * a for a in axis))
    x, y, z = (a / n for a in axis)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    t = 1 - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y], [t * x * y + s * z, t * y * y + c, t * y * z - s * x], [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]

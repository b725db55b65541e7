"""Rotation of the higher spherical harmonics of splats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The real basis of degrees 1 to 3.
C1 = 0.4886025119029199
C2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
C3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def basis(degree: int, d: np.ndarray) -> np.ndarray:
    """The 2 * degree + 1 functions at unit directions."""
    x, y, z = d.T
    if degree == 1:
        rows = (-C1 * y, C1 * z, -C1 * x)
    elif degree == 2:
        rows = (C2[0] * x * y, C2[1] * y * z, C2[2] * (2 * z * z - x * x - y * y), C2[3] * x * z, C2[4] * (x * x - y * y))
    else:
        rows = (
            C3[0] * y * (3 * x * x - y * y), C3[1] * x * y * z, C3[2] * y * (4 * z * z - x * x - y * y), C3[3] * z * (2 * z * z - 3 * x * x - 3 * y * y),
            C3[4] * x * (4 * z * z - x * x - y * y), C3[5] * z * (x * x - y * y), C3[6] * x * (x * x - 3 * y * y),
        )
    return np.stack(rows, 1)


def band_rotation(degree: int, rot: np.ndarray) -> np.ndarray:
    """The matrix that turns a band's coefficients as rot turns directions; built once, on the driver."""
    d = np.random.default_rng(3).normal(size=(64, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    return np.linalg.pinv(basis(degree, d)) @ basis(degree, d @ rot)


def rotate_sh(rest: Column, per_channel: int, rot: np.ndarray) -> Column:
    """A channel-major array of 3 * per_channel coefficients (3, 8 or 15 to a channel), each band turned."""
    degrees = {0: (), 3: (1,), 8: (1, 2), 15: (1, 2, 3)}[per_channel]
    bands = [band_rotation(g, np.asarray(rot)) for g in degrees]
    out = []
    for channel in range(3):
        start = channel * per_channel
        for m in bands:
            for row in m:
                out.append(sum((F.lit(float(v)) * rest[start + k] for k, v in enumerate(row)), F.lit(0.0)))
            start += len(m)
    return F.array(*out) if out else F.array().cast("array<double>")

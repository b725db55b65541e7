"""Which views see which splats: by cells first, equal to every splat against every view."""

import math
import random

import pytest

from geofuse.operators import cloud
from geofuse.plans.shared import few

POSE = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
VIEW = "image_id int, f double, width double, height double, " + ", ".join(f"{k} double" for k in POSE)


def scene(spark, n, spread, hot=0.0):
    rng = random.Random(n)
    point = lambda: [rng.gauss(0, spread) for _ in range(3)] if rng.random() >= hot else [1.0 + rng.random() / 100] * 3
    rows = [(i, *point()) for i in range(n)] + [(n, None, 0.0, 1.0), (n + 1, float("nan"), 0.0, 1.0), (n + 2, 0.0, 0.0, float("inf"))]
    views = []
    for i in range(24):
        a, q = rng.uniform(0, 2 * math.pi), [rng.gauss(0, 1) for _ in range(4)]
        size = math.sqrt(sum(x * x for x in q))
        views.append((i, rng.uniform(200, 900), 640.0, 480.0, *[x / size for x in q], 3 * math.cos(a), 3 * math.sin(a), rng.uniform(-3, 9)))
    return spark.createDataFrame(rows, "splat_id int, x double, y double, z double"), spark.createDataFrame(views, VIEW)


def plain(splats, views):
    out = []
    for i, *p in splats:
        if any(v is None or not math.isfinite(v) for v in p):
            continue
        for k, f, w, h, qw, qx, qy, qz, *t in views:
            m = [[1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qw * qz), 2 * (qx * qz + qw * qy)], [2 * (qx * qy + qw * qz), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qw * qx)], [2 * (qx * qz - qw * qy), 2 * (qy * qz + qw * qx), 1 - 2 * (qx * qx + qy * qy)]]
            x, y, z = (sum(m[r][j] * p[j] for j in range(3)) + t[r] for r in range(3))
            if z > 1e-4 and -0.1 * w <= f * x / z + w / 2 <= 1.1 * w and -0.1 * h <= f * y / z + h / 2 <= 1.1 * h:
                out.append((i, k))
    return sorted(out)


@pytest.mark.parametrize(("spread", "hot", "cells"), [(2.0, 0.0, 32), (2.0, 0.5, 8), (20.0, 0.0, 4), (0.0, 0.0, 32)])
def test_cells_lose_no_view_and_spare_most(spark, spread, hot, cells):
    s, v = scene(spark, 700, spread, hot)
    got = sorted(map(tuple, cloud.in_views(s, v, cells).select("splat_id", "image_id").collect()))
    assert got == plain(map(tuple, s.collect()), list(map(tuple, v.collect())))
    met = cloud.view_candidates(s, v, cells).count()
    assert len(got) <= met <= 700 * 24
    if cells == 32 and spread:
        assert met <= 1.1 * len(got) + 24 < 0.6 * 700 * 24
    assert cloud.in_views(s.limit(0), v).count() == 0 and cloud.in_views(s, v.limit(0)).count() == 0


def test_what_is_sent_to_every_task_is_counted(spark):
    assert few(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError, match="too many views"):
        few(spark.range(6), 5, "views")
    s, v = scene(spark, 10, 1.0)
    with pytest.raises(ValueError, match="too many views"):
        cloud.in_views(s, v.crossJoin(spark.range(1000)).select(*v.columns))

"""Descriptor matches against all pairs, whatever the blocks; components of a mesh that is one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofuse.operators import sfm


def plain(kps, pairs, ratio, most, cross):
    """By the wording: every keypoint of a frame against every one of the other."""
    out = []
    for fa, fb in pairs:
        a, b = ([(i, d) for f, i, d in kps if f == x and d is not None] for x in (fa, fb))
        rank = lambda d, others: sorted((bin((d ^ e) & (1 << 64) - 1).count("1"), j) for j, e in others)
        for i, d in a:
            near = rank(d, b)
            if not near or near[0][0] > most or (len(near) > 1 and near[0][0] > ratio * near[1][0]):
                continue
            j = near[0][1]
            if not cross or rank(next(e for k, e in b if k == j), a)[0][1] == i:
                out.append((fa, fb, i, j, near[0][0]))
    return sorted(out)


@pytest.mark.parametrize(("block", "cross"), [(4096, True), (7, True), (7, False), (1, True)])
def test_matches_equal_all_pairs(spark, block, cross):
    rng = random.Random(6)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(12)]
    kps = [(f, 100 * f + i, base[rng.randrange(12)] ^ sum(1 << rng.randrange(62) for _ in range(rng.randrange(4)))) for f in range(4) for i in range((25, 30, 1, 9)[f])]
    kps += [(1, 190, None), (5, 500, 7)]
    pairs = [(0, 1), (1, 0), (0, 2), (2, 3), (3, 1), (5, 9), (0, 5)]
    df, ps = spark.createDataFrame(kps, "frame_id long, kp_id long, desc long"), spark.createDataFrame(pairs, "fa long, fb long")
    got = sorted(map(tuple, sfm.match_descriptors(df, ps, 0.8, 40, cross, block).select("fa", "fb", "i", "j", "d").collect()))
    assert got == plain(kps, pairs, 0.8, 40, cross) and len(got) > 5


def test_kernel_gives_two_candidates_a_keypoint_and_way(spark):
    """What is shuffled after the comparison: at most two rows a keypoint and way, not a row a pair."""
    kps = spark.range(120).select((F.col("id") % 2).alias("frame_id"), F.col("id").alias("kp_id"), F.xxhash64("id").alias("desc"))
    plan = sfm.match_descriptors(kps, spark.createDataFrame([(0, 1)], "fa long, fb long"), 1.0, 64, False)
    assert plan.count() == 60
    import pyarrow as pa

    side = lambda lo, ids, desc: {ids: [[lo + i for i in range(60)]], desc: [[(lo + i) * 77 for i in range(60)]]}
    key = {"fa": 0, "fb": 1, "pa": 0, "pb": 0}
    out = sfm._compared(pa.table({"a": [key]} | side(0, "ids", "desc")), pa.table({"b": [key]} | side(60, "ids_b", "desc_b")))
    assert out.num_rows == 2 * 120


def test_one_large_component(spark):
    strip = spark.range(3000).select(F.col("id").alias("tri_id"), F.col("id").alias("v0"), (F.col("id") + 1).alias("v1"), (F.col("id") + 2).alias("v2"))
    lone = spark.createDataFrame([(9000, 5000, 5001, 5002), (9001, 6000, 6000, 6000)], "tri_id long, v0 long, v1 long, v2 long")
    rows = sfm.mesh_components(strip.unionByName(lone)).groupBy("component", "size").count().collect()
    assert sorted(map(tuple, rows)) == [(0, 3000, 3000), (5000, 1, 1), (6000, 1, 1)]


def test_blocks_are_compared_in_strips():
    """Two whole blocks: the memory of a strip, not of a table of distances; both ways equal brute force."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, m = 2500, 2000
    sides = [(rng.permutation(10 * k)[:k], rng.integers(0, 1 << 20, k).astype("int64") * 4099) for k in (n, m)]
    key = pa.array([{"fa": 0, "fb": 1, "pa": 0, "pb": 0}])
    left, right = (pa.table({k: key, ids: pa.array([own]), desc: pa.array([bits])}) for k, ids, desc, (own, bits) in (("a", "ids", "desc", sides[0]), ("b", "ids_b", "desc_b", sides[1])))
    tracemalloc.start()
    got = sfm._compared(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * n * m / 2
    rows = set(zip(*(got[k].to_pylist() for k in ("own", "other", "d", "back"))))
    want = set()
    for way, (a, x), (b, y) in ((False, *sides), (True, *sides[::-1])):
        d = np.bitwise_count(x.view("uint64")[:, None] ^ y.view("uint64")[None, :])
        for i in range(len(a)):
            for j in np.lexsort((b, d[i]))[:2]:
                want.add((int(a[i]), int(b[j]), int(d[i, j]), way))
    assert rows == want and got.num_rows == len(want)

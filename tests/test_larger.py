"""What must not grow in one task: rounds of components, windows and joins over few groups, and tasks of small files."""

import numpy as np
from pyspark.sql import functions as F

from geofuse.operators import cloud, sfm
from geofuse.operators import surface as su
from geofuse.plans import components as cp
from geofuse.plans import shared
from geofuse.sources import binary as bi
from geofuse.sources import readers as rd


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_of_one_task_need_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(cp, "_least_neighbour", lambda pairs, real=cp._least_neighbour: rounds.append(1) or real(pairs))
    path = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).coalesce(1)
    got = cp.components(path).collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(i, 0) for i in range(401)]
    assert not rounds


def test_repeated_links_of_several_tasks(spark):
    rows = [(3, 4)] * 5 + [(4, 9), (7, 7), (None, 3), (-5, 4), (20, 21)]
    got = cp.components(spark.createDataFrame(rows, "a long, b long").repartition(5)).collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(-5, -5), (3, -5), (4, -5), (9, -5), (20, 20), (21, 20)]


def test_grid_spread_orders_no_frame_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(f, i, float(rng.integers(0, 64)), float(rng.integers(0, 48)), float(rng.integers(0, 50)) if i % 9 else None) for f, n in ((0, 3000), (1, 40), (2, 101)) for i in range(n)]
    kps = spark.createDataFrame(rows, "frame_id int, kp_id int, x double, y double, score double")
    out = sfm.grid_spread(kps, 64, 48, 100)
    got = {(r["frame_id"], r["kp_id"]) for r in out.collect()}
    want = set()
    for frame in range(3):
        own = sorted((r for r in rows if r[0] == frame), key=lambda r: (r[4] is None, -(r[4] or 0), r[1]))
        cells = {}
        for r in own:
            cells.setdefault((min(r[2] // (64 / 12), 11), min(r[3] // (48 / 9), 8)), r)
        best = set(cells.values())
        order = [r for r in own if r in best] + [r for r in own if r not in best]
        want |= {(r[0], r[1]) for k, r in enumerate(order) if r in best or k < 100}
    assert got == want
    seen = [line for line in plan_of(out).splitlines() if "hashpartitioning(frame_id" in line]
    assert any("__salt" in line for line in seen)


def test_cloud_stats_without_a_join(spark):
    rows = [("a", 1.0, 2.0, 3.0), ("a", 4.0, None, 1.0), ("a", -2.0, 5.0, 0.5), ("b", 1.0, 1.0, 1.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    out = cloud.cloud_stats(df, ["g"])
    assert "Join" not in plan_of(out)
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == {"a", "b"} and got["b"]["rms"] == 0 and got["a"]["n"] == 3
    mean = np.array([1.0, 3.5, 1.5])
    whole = np.array([[1.0, 2.0, 3.0], [-2.0, 5.0, 0.5]])
    assert np.isclose(got["a"]["rms"], np.sqrt(((whole - mean) ** 2).sum(1).mean())) and np.isclose(got["a"]["my"], 3.5)


def test_robust_radius_joins_by_salts(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), "id", *[(F.col("id") * k % 101).cast("double").alias(a) for k, a in ((7, "x"), (11, "y"), (13, "z"))])
    got = {r["g"]: r["radius"] for r in cloud.robust_radius(df, ["g"]).collect()}
    for g in (0, 1):
        p = np.array([[i * 7 % 101, i * 11 % 101, i * 13 % 101] for i in range(3000) if i % 2 == g], "float64")
        away = np.sort(np.sqrt(((p - p.mean(0)) ** 2).sum(1)))
        assert np.isclose(got[g], away[int((len(p) - 1) * 0.9)])
    assert "salt" in plan_of(cloud.robust_radius(df, ["g"]))


def test_small_files_share_a_partition(spark, tmp_path):
    head = "ply\nformat binary_little_endian 1.0\nelement vertex {}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    for i in range(300):
        (tmp_path / f"f{i:03}.ply").write_bytes(head.format(5).encode() + np.full(15, i, "<f4").tobytes())
    df = bi.read_ply(spark, str(tmp_path), chunk=64)
    assert df.rdd.getNumPartitions() < 20
    assert sorted(r["x"] for r in df.collect()) == [float(i) for i in range(300) for _ in range(5)]


def test_small_bricks_share_a_call(spark):
    axis = F.sequence(F.lit(0), F.lit(4))
    field = spark.range(3).select(F.col("id").alias("m"), F.explode(axis).alias("vx")).withColumn("vy", F.explode(axis)).withColumn("vz", F.explode(axis))
    field = field.withColumn("value", F.col("vx") - 1.5 - F.col("m") / 4)
    v, t = su.iso_surface(field, ["m"], brick=2, places=True)
    assert "FlatMapGroups" not in plan_of(v)
    assert {(r["m"], r["x"]) for r in v.collect()} == {(m, 1.5 + m / 4) for m in range(3)} and v.count() == 75
    assert t.count() == 3 * 32 and all(r[f"x{k}"] == 1.5 + r["m"] / 4 for r in t.collect() for k in range(3))


def test_a_line_of_positions_is_cut_once(spark):
    lines = ["% no position", "2024/05/06 07:08:09  -41.25 174.5 12.5 0.01 0.3 0.4", "1700000000,174.5,-41.25,7", "a b c 1", "9 999 -41.25 174.5 x 1 2"]
    out = rd.pos(spark.createDataFrame([(v,) for v in lines], "value string"))
    got = sorted((r["lat_deg"], r["lon_deg"], r["height_m"], r["std_e"], r["std_n"], r["std_u"]) for r in out.collect())
    assert got == [(-41.25, 174.5, 7.0, 0.1, 0.1, 0.2), (-41.25, 174.5, 12.5, 0.02, 0.3, 0.4)]
    assert plan_of(out).count("split(") == 1


def test_scores_read_the_observations_once(spark):
    rows = [(s, i, p, float((i * 7 + p) % 5)) for s in ("a", "b") for i in range(40) for p in range(30) if (i + p) % 3]
    seen = spark.sparkContext.accumulator(0)
    obs = spark.createDataFrame(rows, "solver string, image_id long, point_id long, err_px double")
    obs = obs.mapInArrow(lambda batches: ((seen.add(b.num_rows), b)[1] for b in batches), obs.schema)
    got = {r["solver"]: r for r in sfm.hypothesis_scores(obs, 80).collect()}
    assert seen.value == len(rows)
    assert {s: (r["images"], r["mean_track"]) for s, r in got.items()} == {s: (40, len(rows) / 2 / 30) for s in "ab"}


def test_files_of_records_are_read_one_at_a_time(spark):
    rows = spark.range(50).select((F.col("id") % 3).alias("part"), *[(F.col("id") + i).cast("float").alias(k) for i, k in enumerate(("x", "y", "z", "sx", "sy", "sz"))])
    one = np.zeros(1, bi.RECORD)

    def packed(pdf):
        r = np.repeat(one, len(pdf))
        r["p"], r["s"], r["c"], r["q"] = pdf[["x", "y", "z"]], pdf[["sx", "sy", "sz"]], 7, 9
        return pdf.head(1)[["part"]].assign(content=r.tobytes())

    files = rows.groupBy("part").applyInPandas(packed, "part long, content binary")
    out = bi.read_splat_records(files, ["part"])
    assert "FlatMapGroupsInArrow" in plan_of(out) and "MapInPandas" not in plan_of(out)
    got = sorted((r["part"], r["n"], r["x"], r["sz"], r["alpha"], r["qz"]) for r in out.collect())
    assert got == [(p, n, float(3 * n + p), float(3 * n + p + 5), 7, 9) for p in range(3) for n in range(17 - (p == 2))]


def test_points_meet_the_size_of_their_group_without_one_task(spark):
    groups = shared.stored(spark.createDataFrame([(0, 5), (1, 6)], "g int, n int"), "sizes")
    rows = spark.range(300).select(F.when(F.col("id") < 290, 0).otherwise(1).alias("g"), shared.salt_of("id").alias("salt"), "id")
    few, salted = (shared.with_groups(rows, groups, ["g"], most) for most in (10, 1))
    assert "BroadcastHashJoin" in plan_of(few) and "hashpartitioning(g" not in plan_of(few)
    want = [(i, 5 if i < 290 else 6) for i in range(300)]
    assert sorted((r["id"], r["n"]) for r in few.collect()) == sorted((r["id"], r["n"]) for r in salted.collect()) == want

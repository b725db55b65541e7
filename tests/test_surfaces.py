"""Binary and model files, surfaces, depth images and alignment, against closed forms."""

import collections
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofuse.operators import surface as su
from geofuse.plans.rank import ranked, stride_sample
from geofuse.queries import QUERIES
from geofuse.sources import binary as bi
from geofuse.sources import model as md


def mesh(spark, values):
    """values {(x, y, z): value} -> vertices by number, and triangles."""
    rows = [(0, *map(int, k), float(v)) for k, v in values.items()]
    v, t = su.iso_surface(spark.createDataFrame(rows, "m int, vx long, vy long, vz long, value double"), ["m"])
    return {r["v"]: np.array([r["x"], r["y"], r["z"]]) for r in v.collect()}, [(r["v0"], r["v1"], r["v2"]) for r in t.collect()]


def sides(triangles):
    return collections.Counter(e for a, b, d in triangles for e in ((a, b), (b, d), (d, a)))


def test_sphere_is_closed_and_turned_outward(spark):
    n, r = 16, 5.3
    at = {(x, y, z): math.dist((x, y, z), (7.5, 7.4, 7.6)) - r for x in range(n) for y in range(n) for z in range(n)}
    v, t = mesh(spark, at)
    edges = sides(t)
    assert all(k == 1 and edges[(b, a)] == 1 for (a, b), k in edges.items())
    assert len(v) - len(edges) // 2 + len(t) == 2
    volume = sum(np.dot(v[a], np.cross(v[b], v[d])) for a, b, d in t) / 6
    assert volume == pytest.approx(4 / 3 * math.pi * r**3, rel=0.03)
    assert all(abs(math.dist(p, (7.5, 7.4, 7.6)) - r) < 0.05 for p in v.values())


def test_open_faces_are_cut_alike(spark):
    """Any signs at all: inside the lattice every edge has two triangles, turned against each other."""
    rng, n = random.Random(2), 7
    values = {(x, y, z): rng.uniform(-1, 1) if 0 < min(x, y, z) and max(x, y, z) < n - 1 else 1.0 for x in range(n) for y in range(n) for z in range(n)}
    v, t = mesh(spark, values)
    edges = sides(t)
    assert len(t) > 100 and all(edges[(a, b)] == edges[(b, a)] for a, b in edges)


def test_every_case_makes_loops():
    for inside in range(256):
        for joined in range(64):
            used = {e for t in su.cube_triangles(inside, joined) for e in t}
            crossed = {i for i, (low, axis) in enumerate(su.EDGES) if (inside >> low & 1) != (inside >> (low | 1 << axis) & 1)}
            assert used == crossed


def test_missing_samples_leave_holes(spark):
    at = {(x, y, z): z - 1.5 for x in range(4) for y in range(4) for z in range(4)}
    whole = mesh(spark, at)[1]
    del at[(1, 1, 1)]
    assert len(whole) == 18 and len(mesh(spark, at)[1]) == 10
    assert mesh(spark, {(0, 0, 0): 1.0})[1] == []


def test_bricks_of_any_size_make_one_surface(spark):
    """The same vertices and triangles, whatever the bricks; about one row a sample is dealt out; repeated and null samples."""
    rng = random.Random(8)
    rows = [(m, x - 9, y, z, rng.uniform(-1, 1)) for m in range(2) for x in range(19) for y in range(9) for z in range(9) if rng.random() < 0.97]
    rows += [(0, 0, 0, 0, None), (0, 1, 1, 1, float("nan")), (*rows[50][:4], rows[50][4] - 3)]
    df = spark.createDataFrame(rows, "m int, vx long, vy long, vz long, value double")
    seen = set()
    for brick in (2, 5, 32):
        v, t = su.iso_surface(df, ["m"], iso=0.1, brick=brick)
        vs = sorted(tuple(r) for r in v.collect())
        assert len({r[:2] for r in vs}) == len(vs)
        seen.add((tuple(vs), tuple(sorted(tuple(r) for r in t.collect()))))
    assert len(seen) == 1 and len(next(iter(seen))[1]) > 500


def test_colours_are_carried_onto_the_surface(spark):
    """One colour everywhere gives it to every vertex; colours that follow the place are blended where the edge is cut."""
    rows = [(0, x, y, z, math.dist((x, y, z), (5.5, 5.5, 5.5)) - 3.2, 1.0, 0.0, x / 11) for x in range(12) for y in range(12) for z in range(12)]
    v, _ = su.iso_surface(spark.createDataFrame(rows, "m int, vx long, vy long, vz long, value double, r double, g double, b double"), ["m"], colours=("r", "g", "b"))
    out = v.collect()
    assert len(out) > 50 and all((p["r"], p["g"]) == (1.0, 0.0) and p["b"] == pytest.approx(p["x"] / 11) for p in out)


def test_fused_colours_come_from_the_band_alone(spark):
    """One camera, three voxels on its axis: in the band before the wall, far before it, and behind it beyond the band."""
    from geofuse.operators.solve import tsdf_fuse

    views = spark.createDataFrame([(i, 100.0, 64.0, 48.0, 1.0, *[0.0] * 6) for i in (1, 2)], "image_id int, f double, width double, height double, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    depth = spark.createDataFrame([(1, 24, 32, 1.0, 1.0, 1.0, 0.0), (2, 24, 32, 1.6, 0.5, 0.0, 1.0)], "image_id int, py int, px int, depth double, cos double, r double, g double")
    vox = spark.createDataFrame([(0, 0, k, 0.0, 0.0, z) for k, z in enumerate((0.9, 0.3, 1.5, 1.1))], "vx long, vy long, vz long, x double, y double, z double")
    got = {r["vz"]: (r["sdf"], r["weight"], r["r"], r["g"]) for r in tsdf_fuse(vox, depth, views, 0.3, colours=("r", "g")).collect()}
    assert got[0] == pytest.approx(((0.1 + 0.5 * 0.3) / 1.5, 1.5, 1.0, 0.0))  # the second image measures it too far off for its colour
    assert got[1] == pytest.approx((0.3, 1.5, 0.0, 0.0))
    assert got[2] == pytest.approx((0.1, 0.5, 0.0, 1.0)) and got[3] == pytest.approx(((-0.1 + 0.5 * 0.3) / 1.5, 1.5, 1.0, 0.0))


def test_depth_of_one_wall(spark):
    """Opaque splats on a plane before the camera: its depth and a normal that faces the eye."""
    rows = [(i * 40 + j, (i - 20) / 10, (j - 20) / 10, 5.0) for i in range(40) for j in range(40)]
    s = spark.createDataFrame(rows, "splat_id long, x double, y double, z double").withColumns(
        {"s0": F.lit(math.log(0.1)), "s1": F.lit(math.log(0.1)), "s2": F.lit(math.log(0.001)), "opacity_logit": F.lit(6.0), "qw": F.lit(1.0)} | {k: F.lit(0.0) for k in ("qx", "qy", "qz", "dc0", "dc1", "dc2")}
    )
    v = spark.createDataFrame([(1, 40.0, 32.0, 24.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "image_id long, f double, width double, height double, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    out = su.composite_depth(s, v, 64).collect()
    assert len(out) == 32 * 24
    assert all(r["depth"] == pytest.approx(5, abs=1e-6) and r["nz"] == pytest.approx(-1) and 0.62 <= r["cover"] <= 1 for r in out)
    behind = su.composite_depth(s.withColumn("z", -F.col("z")), v, 64)
    assert behind.count() == 0 and su.composite_depth(s.withColumn("opacity_logit", F.lit(-5.0)), v, 64).count() == 0


def test_tiles_that_are_full_stop_and_rows_are_tiles(spark):
    """Many layers of opaque splats: the depth is the first's; a row a splat and tile is dealt out, whatever the batches."""
    rows = [(i, float(i % 7), float(i % 5), 4.0 + i // 35) for i in range(35 * 40)]
    s = spark.createDataFrame([(i, (x - 3) / 2, (y - 2) / 2, z) for i, x, y, z in rows], "splat_id long, x double, y double, z double").withColumns(
        {k: F.lit(math.log(0.5)) for k in ("s0", "s1", "s2")} | {"opacity_logit": F.lit(9.0), "qw": F.lit(1.0)} | {k: F.lit(0.0) for k in ("qx", "qy", "qz", "dc0", "dc1", "dc2")}
    )
    v = spark.createDataFrame([(k, 40.0, 40.0, 24.0, 1.0, *[0.0] * 6) for k in ("a", "b")], "image_id string, f double, width double, height double, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    whole = sorted(map(tuple, su.composite_depth(s, v, 64).collect()))
    assert len(whole) > 500 and all(r[3] < 5.5 for r in whole)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        parts = sorted(map(tuple, su.composite_depth(s, v, 64).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert [r[:3] for r in parts] == [r[:3] for r in whole] and np.allclose([r[3:] for r in parts], [r[3:] for r in whole])
    t = su._Tile(0, 0)
    one = {k: np.full(3, x) for k, x in {"u": 8.0, "w": 8.0, "e0": 1e5, "e1": 0.0, "e2": 1e5, "det": 1e10, "opacity": 0.99, "depth": 2.0, "nx": 0.0, "ny": 0.0, "nz": 1.0, "vw": 16.0, "vh": 16.0}.items()}
    t.add(one)
    before = t.sums.copy()
    t.add(one | {"depth": np.full(3, 9.0)})
    assert (t.light < su.FULL).all() and (t.sums == before).all()


def ply(fields, rows, count=None):
    head = f"ply\nformat binary_little_endian 1.0\ncomment x\nelement vertex {len(rows) if count is None else count}\n" + "".join(f"property {t} {n}\n" for n, t in fields) + "element face 0\nproperty list uchar int vertex_indices\nend_header\n"
    kind = np.dtype([(n, "<" + bi.PLY_TYPES[t]) for n, t in fields])
    return head.encode() + np.array([tuple(r) for r in rows], kind).tobytes()


def test_points_are_lifted_and_bad_files_refused(spark, tmp_path):
    points = [("x", "float"), ("y", "double"), ("z", "float"), ("red", "uchar"), ("green", "uchar"), ("blue", "uchar")]
    (tmp_path / "a.ply").write_bytes(ply(points, [(i, i / 2, -i, i, 255, 0) for i in range(200)]))
    out = {r["n"]: r for r in bi.read_ply(spark, str(tmp_path / "a.ply"), chunk=1000).collect()}
    assert sorted(out) == list(range(200)) and out[7]["x"] == 7 and out[7]["y"] == 3.5
    assert out[7]["s1"] == pytest.approx(math.log(0.005)) and out[7]["opacity_logit"] == 4 and out[0]["dc1"] == pytest.approx(0.5 / 0.28209479177387814)
    bare = ply(points[:3], [(1, 2, 3)])
    (tmp_path / "b.ply").write_bytes(bare)
    assert bi.read_ply(spark, str(tmp_path / "b.ply")).first()["dc0"] == pytest.approx((128 / 255 - 0.5) / 0.28209479177387814)
    fields = [(n, "float") for n in (*"xyz", *bi.SPLAT, "f_rest_0", "f_rest_1")]
    for k, bad in enumerate((bare[:-1], b"no ply", ply(points[:3], [], 5), ply(fields, [[0] * len(fields)]))):
        (tmp_path / f"bad{k}.ply").write_bytes(bad)
        with pytest.raises(Exception, match="ply|harmonics"):
            bi.read_ply(spark, str(tmp_path / f"bad{k}.ply")).collect()
    (tmp_path / "none.ply").write_bytes(ply(points[:3], []))
    assert bi.read_ply(spark, str(tmp_path / "none.ply")).count() == 0


def test_every_record_is_read_once_whatever_the_ranges(spark, tmp_path):
    """Ranges shorter than a record, than the header, and that end inside records; two files, a hidden one and another kind."""
    fields = [("x", "float"), ("y", "double"), ("z", "float"), ("red", "uchar")]
    for name, n in (("a.ply", 50), ("b.ply", 3), (".c.ply", 9), ("d.txt", 9)):
        (tmp_path / name).write_bytes(ply(fields, [(i, i, i, i) for i in range(n)]))
    for chunk in (7, 17, 100, 1 << 20):
        got = sorted((r["file"][-5:], r["n"], r["x"]) for r in bi.read_ply(spark, str(tmp_path), chunk=chunk).collect())
        assert got == sorted((f, i, i) for f, n in (("a.ply", 50), ("b.ply", 3)) for i in range(n)), chunk
    with pytest.raises(Exception, match="missing.ply"):
        bi.read_ply(spark, str(tmp_path / "missing.ply")).collect()


def test_files_over_two_gib(tmp_path):
    """The last record of a sparse file of 3 GB; its task reads its own range alone, a step at a time."""
    fields = [("x", "float"), ("y", "float"), ("z", "float"), *[(k, "float") for k in bi.SPLAT], *[(f"f_rest_{i}", "float") for i in range(45)]]
    head, n = ply(fields, [], 12_800_000), 12_800_000
    last = np.zeros(1, np.dtype([(k, "<f4") for k, _ in fields]))
    last["x"], last["f_rest_44"] = 7, 0.5
    path = tmp_path / "big.ply"
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + n * last.itemsize)
        f.seek(-last.itemsize, 2)
        f.write(last.tobytes())
    assert path.stat().st_size > 3_000_000_000
    reader = bi.PlyReader({"path": str(path)})
    parts = reader.partitions()
    assert parts[-1].high == path.stat().st_size and all(a.high == b.low for a, b in zip(parts, parts[1:])) and max(p.high - p.low for p in parts) <= bi.CHUNK
    batches = list(reader.read(parts[-1]))
    row = batches[-1].slice(batches[-1].num_rows - 1).to_pylist()[0]
    assert (row["n"], row["x"], row["sh_rest"][44], len(row["sh_rest"])) == (n - 1, 7, 0.5, 45)
    assert sum(b.num_rows for b in batches) * last.itemsize <= bi.CHUNK and max(b.nbytes for b in batches) < 3 * bi.STEP
    firsts = [next(reader.read(p))["n"][0].as_py() for p in (parts[0], parts[50])]
    assert firsts == [0, -(-(parts[50].low - len(head)) // last.itemsize)]
    path.unlink()


def test_splat_round_trip_through_files(spark, sf, tmp_path):
    s = QUERIES["p16_rotate_sh"](spark, sf).select("splat_id", F.expr("transform(rest, x -> float(x))").alias("sh_rest"))
    s = s.withColumns({k: F.col("splat_id") / (i + 3) for i, k in enumerate(("x", "y", "z", "s0", "s1", "s2", "qw", "qx", "qy", "qz", "opacity_logit", "dc0", "dc1", "dc2"))}).withColumn("g", F.lit(1))
    blocks = bi.ply_files(s, ["g"], ["splat_id"], per_file=400).collect()
    assert sum(b["records"] for b in blocks) == s.count() and max(b["records"] for b in blocks) <= 400
    for b in blocks:
        (tmp_path / f"{b['block']:020d}.ply").write_bytes(b["content"])
    want = {np.float32(r["x"]).item(): r for r in s.collect()}
    for r in bi.read_ply(spark, str(tmp_path), chunk=5000).collect():
        w = want[r["x"]]
        assert r["sh_rest"] == w["sh_rest"] and r["dc2"] == np.float32(w["dc2"]) and r["qz"] == np.float32(w["qz"])


def test_rasters(spark, tmp_path):
    z = np.arange(35, dtype="float64").reshape(7, 5)
    z[2, 3] = np.nan
    (tmp_path / "a.tif").write_bytes(bi.write_float_raster(z, rows_per_strip=3))
    (tmp_path / "b.tif").write_bytes(bi.write_float_raster(z[:1], rows_per_strip=3))
    got = {(r["file"][-5:], r["row"], r["col"]): r["z"] for r in bi.read_dem(spark, str(tmp_path)).collect()}
    assert len(got) == 40 and got[("a.tif", 0, 0)] == 30 and got[("a.tif", 4, 3)] is None and got[("b.tif", 0, 4)] == 4
    big = struct.pack(">2sHI", b"MM", 42, 8)
    with pytest.raises(ValueError):
        bi.float_raster(b"II*\0" + big)
    with pytest.raises(ValueError):
        bi.float_raster(bi.write_float_raster(z)[:-8])


def test_sparse_models_as_text(spark, tmp_path):
    cameras = spark.createDataFrame([("m", 1, "PINHOLE", 640, 480, [500.0, 501.0, 320.0, 240.0]), ("m", 2, "SIMPLE_RADIAL", 64, 48, [50.0, 32.0, 24.0, 0.01])], "m string, camera_id long, model string, width long, height long, params array<double>")
    images = spark.createDataFrame([("m", 1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1, "img 0.jpg"), ("m", 2, 0.9238795, 0.0, 0.3826834, 0.0, 1.0, -2.0, 3.0, 1, "7")], "m string, image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long, name string")
    obs = spark.createDataFrame([("m", 1, 0, 10.0, 20.0, 7), ("m", 1, 1, 30.0, 40.0, None)], "m string, image_id long, idx int, x double, y double, point_id long")
    points = spark.createDataFrame([("m", 7, 1.0, 2.0, 3.0, 10, 20, 30, 0.5), ("m", 8, 1e-7, 2.0, 3.0, 10, 20, 30, 0.5)], "m string, point_id long, x double, y double, z double, r int, g int, b int, error double")
    track = spark.createDataFrame([("m", 7, 1, 0), ("m", 7, 2, 5)], "m string, point_id long, image_id long, idx int")
    md.write_sfm_text(f"{tmp_path}/model", ["m"], cameras, images, obs, points, track)
    back = md.read_sfm_text(spark, f"{tmp_path}/model", ["m"])
    for name, df in (("images", images), ("obs", obs), ("points", points), ("track", track)):
        assert sorted(map(repr, back[name].select(*df.columns).collect())) == sorted(map(repr, df.collect())), name
    f = {r["camera_id"]: r for r in md.focal_and_centre(back["cameras"]).collect()}
    assert (f[1]["fx"], f[1]["fy"], f[1]["cx"], f[1]["cy"]) == (500, 501, 320, 240) and (f[2]["fx"], f[2]["fy"], f[2]["cx"]) == (50, 50, 32)
    (tmp_path / "images.txt").write_text("# two lines\n#  each\n3 1 0 0 0 0 0 0 1 a b.png\n1.5 2.5 -1 3 4 9\n4 1 0 0 0 0 0 0 1 c.png\n\n")
    lines = spark.read.text(f"{tmp_path}/images.txt").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    im, ob = md.parse_images(md.numbered(lines), [])
    assert {r["image_id"]: r["name"] for r in im.collect()} == {3: "a b.png", 4: "c.png"}
    assert sorted((r["idx"], r["x"], r["point_id"]) for r in ob.collect()) == [(0, 1.5, None), (1, 3.0, 9)]
    assert md.parse_cameras(spark.createDataFrame([("1 PINHOLE 6 4 1 2",), ("x",), ("# 1 PINHOLE",), ("2 FISHEYE 1 1 1",)], "value string")).count() == 0


def model_lines(spark, path):
    return spark.read.text(str(path)).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))


def plain_images(text):
    """Line by line: a blank line is skipped where an image is due, the line after an image has its observations."""
    images, seen, due = {}, [], None
    for line in text.split("\n"):
        f = line.split()
        if line.strip().startswith("#"):
            continue
        if due is None:
            if f:
                due = int(f[0])
                images[due] = " ".join(f[9:])
        else:
            seen += [(due, i, float(f[3 * i]), float(f[3 * i + 1]), int(f[3 * i + 2]) if int(f[3 * i + 2]) >= 0 else None) for i in range(len(f) // 3)]
            due = None
    return images, sorted(seen, key=str)


def test_blank_lines_between_images_change_nothing(spark, tmp_path):
    """Blank lines and comments anywhere, an empty line of observations, tabs, left-over fields; files of many blocks."""
    rng = np.random.default_rng(4)
    for k in range(6):
        out = []
        for i in range(40):
            out += [""] * int(rng.integers(0, 3)) * int(k > 0) + ["# note"] * int(rng.integers(0, 2))
            out.append(f" {i}\t1 0 0 0 0.5 0 0 1 img  {i} .jpg")
            out += ["# between"] * int(rng.integers(0, 2))
            n = int(rng.integers(0, 4))
            out.append(" \t" * int(rng.integers(0, 2)) if not n else " ".join(f"{j}.5 {i} {j - 1}" for j in range(n)) + " 7" * int(rng.integers(0, 3)))
        text = "\n".join(out) + "\n" * int(k % 2)
        path = tmp_path / f"images{k}.txt"
        path.write_text(text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 300)  # blocks cut anywhere
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            lines = model_lines(spark, path)
            assert lines.select("_at").distinct().count() > 5
            images, seen = md.parse_images(md.numbered(lines), [])
            got = {r["image_id"]: r["name"] for r in images.collect()}, sorted((tuple(r[c] for c in ("image_id", "idx", "x", "y", "point_id")) for r in seen.collect()), key=str)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        want = plain_images(text)
        assert got == want and len(want[0]) == 40, k


@pytest.mark.parametrize(
    ("text", "message"),
    [("1 1 0 0 0 0 0 0 1\n\n", "malformed image line"), ("x 1 0 0 0 0 0 0 1 a.png\n\n", "no number in image line"), ("1 1 0 0 0 0 no 0 1 a.png\n\n", "no number in image line"), ("1 1 0 0 0 0 0 0 1 a.png\n1 b 2\n", "observations of image 1")],
)
def test_malformed_images_are_an_error(spark, tmp_path, text, message):
    (tmp_path / "images.txt").write_text("\n" + text)
    images, seen = md.parse_images(md.numbered(model_lines(spark, tmp_path / "images.txt")), [])
    with pytest.raises(Exception, match=message):
        (seen if "observations" in message else images).collect()


def test_alignment_is_gated(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, *map(float, p)) for g in range(4) for i, p in enumerate(rng.normal(0, 2, (64 if g < 3 else 5, 3)))]
    a = spark.createDataFrame(rows, "g int, i int, x double, y double, z double")
    far = F.when(F.col("g") == 1, 1000.0).otherwise(0.0)
    same = {r["g"]: r for r in su.align_cloud(a, a, ["g"], ["i"]).collect()}
    assert all(same[g]["scale"] == pytest.approx(1) and same[g]["degrees"] == pytest.approx(0, abs=1e-4) and same[g]["accepted"] for g in range(3)) and not same[3]["accepted"]
    turned = a.selectExpr("g", "i", "-x * 2 AS x", "-y * 2 AS y", "z * 2 AS z")
    out = {r["g"]: r for r in su.align_cloud(a, turned.withColumn("x", F.col("x") + far), ["g"], ["i"]).collect()}
    assert out[0]["degrees"] == pytest.approx(180) and out[0]["scale"] == pytest.approx(2) and not out[0]["accepted"]
    assert out[1]["tx"] == pytest.approx(1000)


def test_alignment_is_of_all_points(spark):
    """Every other point of a reference is moved aside, and the reference of another group has points between: each counts."""
    rng = np.random.default_rng(4)
    at = rng.normal(0, 2, (4096, 3))
    a = spark.createDataFrame([(g, i, *map(float, at[i])) for g, n in ((0, 4096), (1, 100)) for i in range(n)], "g int, i int, x double, y double, z double")
    b = a.withColumn("x", F.col("x") + F.when(F.col("g") == 0, F.col("i") % 2).otherwise(0.0))
    between = a.filter("g = 1").withColumns({"i": F.col("i") + 0.5, "y": F.col("y") + 3.0})
    b = b.select("g", F.col("i").cast("double").alias("i"), *"xyz").unionByName(between)
    for source, reference, way in ((a, b, 1), (b, a, -1)):
        out = {r["g"]: r for r in su.align_cloud(source, reference, ["g"], ["i"]).collect()}
        assert out[0]["n"] == 4096 and out[1]["n"] == 200 and out[0]["accepted"] and out[1]["accepted"]
        lies = {}
        for g, n in ((0, 4096), (1, 100)):
            l, q = at[:n], at[:n] + np.outer(np.arange(n) % 2, [1, 0, 0]) if g == 0 else at[:n]
            if g == 1:
                l, q = np.repeat(l, 2, 0), np.stack([l, l + [0, 3, 0]], 1).reshape(-1, 3)
            l, q = (l, q)[::way]
            dl, dq = l - l.mean(0), q - q.mean(0)
            u, _, vt = np.linalg.svd(dl.T @ dq)
            lies[g] = (vt.T @ u.T, np.sqrt((dq**2).sum() / (dl**2).sum()), l.mean(0), q.mean(0))
        for g, (rot, scale, ml, mq) in lies.items():
            r = out[g]
            assert r["scale"] == pytest.approx(scale) and [r[f"r{i}{j}"] for i in range(3) for j in range(3)] == pytest.approx(list(rot.ravel()), abs=1e-9)
            assert [r["tx"], r["ty"], r["tz"]] == pytest.approx(list(mq - scale * rot @ ml), abs=1e-9)


def test_ranks_and_strides(spark):
    rows = [(g, (i * 37) % 101) for g in range(2) for i in range(101 if g else 7)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    got = {(r["g"], r["v"]): (r["rank"], r["__n"]) for r in ranked(df, ["g"], ["v"]).collect()}
    for g, n in ((0, 7), (1, 101)):
        order = sorted(v for k, v in rows if k == g)
        assert all(got[(g, v)] == (i, n) for i, v in enumerate(order))
    s = {(r["g"], r["k"]): r["v"] for r in stride_sample(df, ["g"], ["v"], 10).collect()}
    assert {k: s[(1, k)] for k in range(10)} == {k: int(k * 10.1) for k in range(10)} and sum(g == 0 for g, _ in s) == 7


def test_surface_area_of_the_query(spark, sf):
    r = max(QUERIES["g5_surface_area"](spark, sf).collect(), key=lambda r: r["volume"])
    assert r["volume"] > 10 and r["area"] > 20 and r["triangles"] > 100


def test_splats_behind_full_pixels_are_not_dealt_out(spark, monkeypatch):
    """Many layers before a view, and a row of pixels that no tile fills: the same image, from far fewer rows."""
    rows = [(i, (i * 37 % 101 - 50) / 20, (i * 53 % 89 - 44) / 30, 4.0 + i / 8000) for i in range(16000)]
    s = spark.createDataFrame(rows, "splat_id long, x double, y double, z double").withColumns(
        {k: F.lit(math.log(0.1)) for k in ("s0", "s1", "s2")} | {"opacity_logit": (F.col("splat_id") % 5).cast("double"), "qw": F.lit(1.0)} | {k: F.lit(0.0) for k in ("qx", "qy", "qz", "dc0", "dc1", "dc2")}
    )
    v = spark.createDataFrame([(1, 40.0, 40.0, 24.0, 1.0, *[0.0] * 6)], "image_id long, f double, width double, height double, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(su, "_composited", lambda batches, real=su._composited: real((seen.add(b.num_rows), b)[1] for b in batches))
    got = {}
    for sparse in (1 << 40, 4):
        monkeypatch.setattr(su, "SPARSE", sparse)
        before = seen.value
        got[sparse] = sorted(map(tuple, su.composite_depth(s, v, 40).collect())), seen.value - before
    (plain, every), (image, some) = got.values()
    assert len(plain) > 300 and [r[:3] for r in image] == [r[:3] for r in plain] and np.allclose([r[3:] for r in image], [r[3:] for r in plain], rtol=0, atol=1e-12)
    assert some < every / 2

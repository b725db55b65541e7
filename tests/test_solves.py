"""Operators beyond SQL, against closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofuse.operators import cloud, solve
from geofuse.operators import telemetry as tm
from geofuse.plans.rank import nth_smallest
from geofuse.queries import QUERIES
from geofuse.queries.more import _pairs
from geofuse.sources import readers


def test_fit_recovers_scale_and_rotation(spark, sf):
    rng = np.random.default_rng(2)
    rows, half = [], np.radians(20)
    rot = np.array([[np.cos(half), -np.sin(half), 0], [np.sin(half), np.cos(half), 0], [0, 0, 1]])
    for g in range(3):
        for i, p in enumerate(rng.normal(0, 10, (12, 3))):
            q = (1.5 + g) * rot @ p + [1, 2, 3]
            if g == 2 and i == 5:
                q = q + [9, 0, 0]
            rows.append((g, i, *map(float, p), *map(float, q)))
    pairs = spark.createDataFrame(rows, "group_id long, gcp_id long, lx double, ly double, lz double, qx double, qy double, qz double")
    fits = tm.fit_sim3(pairs, ["group_id"])
    by = {r["group_id"]: r for r in fits.collect()}
    for g in (0, 1):
        assert by[g]["scale"] == pytest.approx(1.5 + g)
        assert [by[g][f"r{i}{j}"] for i in range(3) for j in range(3)] == pytest.approx(rot.ravel().tolist(), abs=1e-9)
        assert (by[g]["tx"], by[g]["ty"], by[g]["tz"]) == pytest.approx((1, 2, 3))
    points, stats = tm.gcp_residuals(pairs, fits, ["group_id"])
    assert {(r["group_id"], r["gcp_id"]) for r in points.filter("outlier").collect()} == {(2, 5)}
    assert all(r["mean_m"] < 1e-6 for r in stats.filter("group_id < 2").collect())
    assert QUERIES["a3_gcp_residuals"](spark, sf).count() == 10


def test_two_view_verify_drops_moved_matches(spark, sf):
    out = QUERIES["m1_two_view_verify"](spark, sf).collect()
    assert len(out) == 11
    for r in out:
        assert r["inliers"] >= 0.8 * r["matches"]
        assert r["inliers"] <= r["matches"] * 6 / 7 + 4


def test_two_view_verify_by_pieces(spark, monkeypatch):
    """One pair with repeats, moved matches and one without coordinates: pieces change nothing, and every match counts."""
    rng = np.random.default_rng(3)
    p = rng.uniform([-2, -2, 4], [2, 2, 9], (600, 3))
    a, b = p[:, :2] / p[:, 2:], (p[:, :2] - [0.8, 0]) / (p[:, 2:] + 1)
    b[:100] += [0.3, -0.3]
    rows = [(0, 1, *map(float, (*x, *y))) for x, y in zip(a, b)]
    rows += rows[-50:] + [(0, 1, None, 0.0, 0.0, 0.0), (0, 1, float("nan"), 0.0, 0.0, 0.0)]
    m = spark.createDataFrame(rows, "fa long, fb long, x1 double, y1 double, x2 double, y2 double")
    found = []
    for piece in (1 << 16, 50):
        monkeypatch.setattr(solve, "PIECE", piece)
        found += solve.two_view_verify(m, 800.0).collect()
    for r in found:
        assert r["matches"] == 652 and 550 <= r["inliers"] <= 560
        e = np.array([r[k] for k in solve.NAMES]).reshape(3, 3)
        want = np.array([[0, -1, 0], [1, 0, 0.8], [0, -0.8, 0]])
        want = want / np.linalg.norm(want)
        assert min(np.abs(e - want).max(), np.abs(e + want).max()) < 2e-2
    assert len(found) == 2 and found[0]["inliers"] == found[1]["inliers"]


def test_points_on_the_line_of_their_cameras_come_back(spark, tmp_path):
    """Splats that both cameras of a pair see in one direction, among others, and what lies on such a line has no point of its own."""
    k = np.arange(1, 1_200_000)
    x, z, fa = k * 31 % 997, k * 7 % 211, k % 11
    on = (x - 80 * fa) * (fa % 3 - (fa + 1) % 3) * 100 == 80 * (z + 400 + 100 * (fa % 3))
    keys = np.concatenate([k[on][:200], k[:200]])
    rows = [(int(i), next(j for j in range(1, 500) if j * 17 % 499 == 250)) for i in dict.fromkeys(keys.tolist())]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["pair_id"]: (r["wx"], r["wy"], r["wz"]) for r in QUERIES["m2_triangulate"](spark, str(tmp_path)).collect()}
    assert on.sum() >= 100 and got == {i: (i * 31 % 997 / 100, 2.5, i * 7 % 211 / 100) for i, _ in rows}
    m, poses = _pairs(spark, str(tmp_path))
    assert solve.triangulate(m.filter(F.col("pair_id").isin(k[on][:200].tolist())), poses).count() == 0


def test_ground_plane_is_the_floor(spark, sf):
    r = QUERIES["a28_ground_plane"](spark, sf).first()
    want = np.array([-0.1, 0.05, 1]) / np.linalg.norm([-0.1, 0.05, 1])
    assert abs(np.dot([r["nx"], r["ny"], r["nz"]], want)) > 0.9999 and r["nz"] > 0 and r["share"] > 0.7
    few = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double").withColumn("k", F.lit(1))
    assert solve.ground_plane(few, "k").count() == 0


def test_voxels_stay_in_extent(spark, sf):
    v = QUERIES["a8_voxelize_splats"](spark, sf)
    b = v.agg(F.min("bx"), F.max("bx"), F.min("bz"), F.max("bz"), F.count(F.lit(1))).first()
    assert b[0] >= 0 and b[1] <= 34 and b[2] >= 0 and b[3] <= 34 and b[4] > 100
    assert {r["block"] for r in v.select("block").distinct().collect()} <= {p[0] for p in cloud.PALETTE}


@pytest.mark.parametrize("q", [0.0, 0.37, 0.9, 1.0])
def test_rank_is_exact(spark, q):
    rng = np.random.default_rng(4)
    values = [("a", float(v)) for v in rng.normal(0, 1, 5000)] + [("b", float(v)) for v in rng.integers(0, 5, 3000)] + [("c", 7.0)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r["g"]: r["v"] for r in nth_smallest(df, "v", F.floor((F.col("n") - 1) * q), ["g"]).collect()}
    for g in "abc":
        own = sorted(v for k, v in values if k == g)
        assert got[g] == own[int((len(own) - 1) * q)]


def test_readers_over_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# c\nLat,Lon,alt,time\n-41.5,174.7,12,2024-01-02 03:04:05\nx,1,2,3\n")
    (tmp_path / "b.SRT").write_text("1\n00:00\n[latitude: -41.1] [longitude: 174.2] [rel_alt: 3.5]\n\n2\n00:01\nno fix\n")
    (tmp_path / "c.kml").write_text("<kml><coordinates>174.1,-41.2,5 174.2,-41.3</coordinates></kml>")
    (tmp_path / "d.pos").write_text("% c\n2024/01/02 03:04:05.0 -41.5 174.9 30.0 0.01\n")
    (tmp_path / "e.MRK").write_text("1\t100.5\t-41.7\t174.3\t9\t0.001\t0.02\t0.03\n")
    rows = readers.read_sources(spark, str(tmp_path)).collect()
    assert sorted(r["source"] for r in rows) == ["csv", "kml", "kml", "mrk", "pos", "srt"]
    by = {r["source"]: r for r in rows}
    assert by["csv"]["unix_s"] == 1704164645 and by["csv"]["std_u"] == 4.0
    assert by["srt"]["height_m"] == 3.5 and by["mrk"]["std_n"] == 0.01 and by["pos"]["std_e"] == 0.02 and by["pos"]["lat_deg"] == -41.5
    gpx = tmp_path / "t.gpx"
    gpx.write_text('<gpx><wpt lat="-41" lon="174"><ele>1</ele></wpt><trk><trkseg><trkpt lat="-41.5" lon="174.5"><ele>2</ele><time>2024-01-02T03:04:05Z</time></trkpt></trkseg></trk></gpx>')
    g = {r["std_e"]: r for r in readers.read_gpx(spark, str(gpx)).collect()}
    assert g[3.0]["unix_s"] == 1704164645 and g[2.0]["unix_s"] is None


@pytest.mark.parametrize("per_channel", [3, 8, 15])
def test_turned_harmonics_look_turned(spark, per_channel):
    from geofuse.functions.harmonics import basis, rotate_sh
    from geofuse.functions.splat import axis_rotation

    rot = np.array(axis_rotation((1, 2, 3), 50))
    rest = np.random.default_rng(6).normal(size=3 * per_channel)
    df = spark.createDataFrame([(rest.tolist(),)], "rest array<double>")
    turned = np.array(df.select(rotate_sh(F.col("rest"), per_channel, rot).alias("t")).first()["t"])
    d = np.random.default_rng(7).normal(size=(20, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    degrees = {3: (1,), 8: (1, 2), 15: (1, 2, 3)}[per_channel]
    at = lambda v: np.concatenate([basis(g, v) for g in degrees], 1)
    for k in range(3):
        own = slice(k * per_channel, (k + 1) * per_channel)
        assert at(d @ rot.T) @ turned[own] == pytest.approx(at(d) @ rest[own], abs=1e-9)


def test_densify_keeps_the_true_points(spark, sf):
    out = QUERIES["m3_densify_matches"](spark, sf).collect()
    ids = {r["pair_id"] for r in out}
    assert len(ids) > 600 and not any(i % 3 == 0 or i % 7 == 0 for i in ids)
    assert all(r["wx"] == pytest.approx(r["pair_id"] * 31 % 997 / 100, abs=1e-6) for r in out)


def test_sources_of_every_kind_and_header(spark, tmp_path):
    (tmp_path / "in side").mkdir()
    (tmp_path / "a.csv").write_text("lat,lon,alt\n-41.5,174.7,12\n")
    (tmp_path / "in side" / "b.CSV").write_text("# c\nname,Longitude,Latitude\n\"q, r\",174.9,-41.6\n")
    (tmp_path / "in side" / "t.GPX").write_text('<gpx><wpt lat="-41" lon="174"><ele>1</ele></wpt><trk><trkseg><trkpt lat="-41.2" lon="174.5"><ele>2</ele></trkpt></trkseg></trk></gpx>')
    (tmp_path / "e.MRK").write_text("1\t100.5\t-41.7\t174.3\t9\n")
    (tmp_path / "bad.kml").write_text("<kml/>")
    rows = readers.read_sources(spark, str(tmp_path)).collect()
    got = {(r["source"], r["lat_deg"], r["lon_deg"], r["file"].rsplit("/", 1)[1]) for r in rows}
    assert len(rows) == 5 and got == {("csv", -41.5, 174.7, "a.csv"), ("csv", -41.6, 174.9, "b.CSV"), ("gpx", -41.0, 174.0, "t.GPX"), ("gpx", -41.2, 174.5, "t.GPX"), ("mrk", -41.7, 174.3, "e.MRK")}
    assert [(r["file"].rsplit("/", 1)[1], r["warning"]) for r in readers.source_warnings(spark, str(tmp_path)).collect()] == [("bad.kml", "no positions")]
    # Control points aren't telemetry; positions by name; folders of tiles, and those five deep, are left out.
    (tmp_path / "my_GCP.csv").write_text("lat,lon\n1,2\n")
    (tmp_path / "flight_ppk.txt").write_text("2024/01/02 03:04:05.0 -41.5 174.9 30.0 0.01\n")
    (tmp_path / "notes.txt").write_text("2024/01/02 03:04:05.0 -41.5 174.9 30.0 0.01\n")
    for folder in ("in side/tiles", "1/2/3/4", "1/2/3/4/5"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.csv").write_text("LATITUDE, lng \n-1,2\n")
    more = [(r["source"], r["file"].rsplit("/", 2)[1:]) for r in readers.read_sources(spark, str(tmp_path)).collect()]
    assert len(more) == 7 and ("pos", [tmp_path.name, "flight_ppk.txt"]) in more and ("csv", ["4", "x.csv"]) in more


def test_many_headers_are_one_plan(spark, tmp_path):
    """Forty headers, columns in any order, names twice: one scan of the files, each read by its own header."""
    for i in range(40):
        names = ["lat", "lon", *[f"c{k}" for k in range(i % 5)], "Lat"]
        turn = i % len(names)
        values = {"lat": str(i), "lon": str(i + 0.5), "Lat": "99"} | {f"c{k}": '"a, b"' for k in range(5)}
        head = names[turn:] + names[:turn]
        row = [values[k] if k != "Lat" else (str(i) if head.index("Lat") < head.index("lat") else "99") for k in head]
        row = [("99" if k == "lat" and head.index("Lat") < head.index("lat") else v) for k, v in zip(head, row)]
        (tmp_path / f"{i}.csv").write_text(",".join(head) + "\n" + ",".join(row) + "\n")
    df = readers._csv_files(spark, str(tmp_path))
    assert sorted((r["lat_deg"], r["lon_deg"]) for r in df.collect()) == [(float(i), i + 0.5) for i in range(40)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2

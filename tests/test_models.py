"""Sparse models as text."""

import time

from geofuse.sources import model as md


def test_observations_of_a_large_image(spark):
    """A row an observation must not carry its image's line: 60 000 of one image would copy 250 GB."""
    n = 60_000
    told = " ".join(f"{i}.5 {i}.25 {i if i % 5 else -1}" for i in range(n))
    rows = [("f", 0, 0, "7 1 0 0 0 0 0 0 1 a b.jpg", 0), ("f", 0, 1, told + " 1 2", 1)]
    lines = spark.createDataFrame(rows, "_file string, _at long, _k long, value string, _since long").drop("_at")
    images, obs = md.parse_images(lines, [])
    began = time.monotonic()
    got = obs.orderBy("idx").collect()
    assert time.monotonic() - began < 20
    assert [(r["idx"], r["x"], r["y"], r["point_id"]) for r in got[3:6]] == [(3, 3.5, 3.25, 3), (4, 4.5, 4.25, 4), (5, 5.5, 5.25, None)]
    assert len(got) == n and images.first()["name"] == "a b.jpg"


def test_points_and_their_tracks(spark):
    lines = spark.createDataFrame([("5 1 2 3 9 8 7 0.5 1 10 2 20 3",), ("6 1 2 3 9 8 7 0.5",), ("# no",)], "value string")
    points, track = md.parse_points(lines, [])
    assert {r["point_id"] for r in points.collect()} == {5, 6}
    assert sorted(tuple(r) for r in track.collect()) == [(5, 1, 10), (5, 2, 20)]

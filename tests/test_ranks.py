"""Exact order statistics in rounds, for groups of any size and any ties."""

import random

import pytest
from pyspark.sql import functions as F

from geofuse.plans import rank
from geofuse.plans.rank import nth_smallest


@pytest.mark.parametrize("kind", ["distinct", "few", "heavy", "skew", "edge"])
def test_rounds_equal_sorting(spark, kind):
    rng = random.Random(kind)
    make = {
        "distinct": lambda: rng.random(), "few": lambda: float(rng.randrange(3)), "heavy": lambda: 5.0 if rng.random() < 0.95 else rng.random() * 10,
        "skew": lambda: rng.paretovariate(0.3), "edge": lambda: rng.choice((1.0, 2.0, 1 + rng.random())),
    }[kind]
    rows = [(g, make() if rng.random() > 0.02 else None) for g, n in ((1, 6000), (2, 300), (3, 31), (4, 1)) for _ in range(n)] + [(5, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for share in (0.0, 0.37, 0.5, 1.0):
        got = {r["g"]: r["v"] for r in nth_smallest(df, "v", F.floor((F.col("n") - 1) * share), ["g"], accuracy=200, most=30).collect()}
        own = {g: sorted(v for k, v in rows if k == g and v is not None) for g in range(1, 6)}
        assert got == {g: v[int((len(v) - 1) * share)] for g, v in own.items() if v}, share


def test_one_group_is_the_table_and_no_window_holds_it(spark):
    n = 200_000
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(n * 5)).alias("v"))
    want = sorted(r[0] for r in df.collect())
    for k in (0, 777, n // 2, n - 1):
        out = nth_smallest(df, "v", F.lit(k), [], most=1000)
        assert [r["v"] for r in out.collect()] == [want[k]] and out.columns == ["v"]
    assert nth_smallest(df, "v", F.lit(n), [], most=1000).isEmpty() and nth_smallest(df.limit(0), "v", F.lit(0), []).isEmpty()


def test_what_is_ordered_is_bounded(spark, monkeypatch):
    """Rows that reach the ordered part: under the bound for each group, however large the table."""
    stored, seen = rank.stored, []

    def watched(df, label):
        out = stored(df, label)
        if label == "rank-rounds":
            seen.append(out.agg(F.max(F.when(F.col("found").isNull(), F.col("m")))).first()[0])
        return out

    monkeypatch.setattr(rank, "stored", watched)
    df = spark.range(100_000).select(F.sqrt("id").alias("v"))
    assert nth_smallest(df, "v", F.lit(50_000), [], most=500).first()["v"] == 50_000**0.5
    assert seen[-1] is None or seen[-1] <= 500
    assert len(seen) <= 4

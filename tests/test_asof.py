"""As-of joins against plain loops; keys cut into pieces give the same, and no piece holds many rows."""

import random

import pytest
from pyspark.sql import functions as F

from geofuse.plans import asof


def tables(spark, hot):
    rng = random.Random(hot)
    key = lambda: 1 if rng.random() < hot else rng.randint(2, 5)
    left = [(key(), i, rng.choice((None, float(rng.randint(0, 300)), 1000.0 + rng.random()))) for i in range(400)] + [(None, 400, 3.0), (77, 401, 5.0)]
    right = [(key(), i, rng.choice((None, float(rng.randint(0, 300)), 1e6))) for i in range(300)] + [(None, 300, 4.0), (88, 301, 5.0)]
    schema = "k long, {} long, t double"
    return left, right, spark.createDataFrame(left, schema.format("i")), spark.createDataFrame(right, schema.format("j"))


def plain(left, right):
    out = []
    for k, i, t in left:
        own = sorted((rt, j) for rk, j, rt in right if rk == k and rt is not None)
        first = {rt: j for rt, j in reversed(own)}
        prev = max((rt for rt in first if t is not None and rt <= t), default=None)
        nxt = min((rt for rt in first if t is not None and rt >= t), default=None)
        out.append((i, first.get(prev), first.get(nxt)))
    return sorted(out)


@pytest.mark.parametrize(("hot", "piece"), [(0.3, 1 << 20), (0.3, 40), (1.0, 20), (1.0, 1), (0.9, 7)])
def test_neighbours_equal_plain_loops(spark, hot, piece):
    left, right, a, b = tables(spark, hot)
    out = asof.neighbours(a, b, ["k"], "t", "j", ["j"], piece)
    assert sorted((r["i"], r["prev"] and r["prev"]["j"], r["next"] and r["next"]["j"]) for r in out.collect()) == plain(left, right)


def test_a_key_that_is_the_table_is_cut(spark):
    """One track of 20000 rows, crowded in time: pieces of about 500, whatever the times; the join as without pieces."""
    n = 20000
    a = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.pow(F.col("id") / n, F.lit(8)).alias("t"))
    b = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("j"), (F.pow(F.col("id") / n, F.lit(8)) + 1e-9).alias("t"))
    hot = asof._hot(a.select("k", "t").unionAll(b.select("k", "t")), ["k"], "t", 500)
    size = a.join(hot, "k").groupBy(asof._piece("t").alias("p")).count().agg(F.max("count"), F.count("p")).first()
    assert size[0] <= 600 and 70 <= size[1] <= 81
    cut, whole = (asof.asof_nearest(a, b, ["k"], "t", "j", ["j"], piece=p).select("i", "j") for p in (500, 1 << 20))
    assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty() and cut.count() == n
    assert asof._hot(a.select("k", "t"), ["k"], "t", 1 << 20) is None

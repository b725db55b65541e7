import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geofuse.llm import topk

SCHEMA = "vec_id long, embedding array<float>, v string, grp string, score int"


def brute(rows, asks, k):
    """By the wording: all products, sorted."""
    out = []
    rows = [(i, list(v)) for i, v in rows if i is not None and v is not None]
    for q, a in {(i, tuple(v)) for i, v in asks if i is not None and v is not None}:
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, v array<long>")


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_op13_equals_brute_force(spark, sf):
    pdf = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    rows = [(int(i), np.floor(256 * np.asarray(v, "float64")).astype(int).tolist()) for i, v in zip(pdf["vec_id"], pdf["embedding"])]
    df = topk.op13_topk(spark, sf)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert got(df) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(con.execute(topk.ORACLES["op13_topk"]).df()[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == got(df)


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_many_stripes_and_groups(spark, spread):
    """Lengths alike and lengths far apart, directions of low rank, copies and ties, over many blocks."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 4)) @ rng.normal(size=(4, 12)) + 0.2 * rng.normal(size=(900, 12))
    v = np.floor(v * 40 * np.exp(spread * rng.normal(size=(900, 1)))).astype(int)
    v[300:600] = v[7]
    v[600:640] = 0
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    asks = [r for r in rows if r[0] % 20 == 0]
    assert got(topk.top_k(frame(spark, rows), frame(spark, asks), 4, per_group=9, block=16, stripe=2)) == brute(rows, asks, 4)


def test_pruning_leaves_out_stripes_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32)) * np.linspace(3, 0.05, 32)
    q = x[:50]
    full = q @ x.T
    need = np.sort(full, axis=1)[:, -5]
    i, j = topk._reached(q, x, need, [4, 12, 32])
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in zip(*np.nonzero(full >= need[:, None] - 1e-9))}


def test_odd_rows(spark):
    """Null ids and vectors, null and non-finite components, shorter and empty vectors, repeats, fewer than k."""
    nan, inf = float("nan"), float("inf")
    data = [
        (None, [1.0, 2.0]), (0, None), (50, [1.0, None]), (100, [nan, 1.0]), (150, [inf, 1.0]), (1, [-inf, 0.0]),
        (200, [1.0, 0.5]), (200, [1.0, 0.5]), (200, [0.1, 0.1]), (2, [1.0]), (3, []), (4, [-0.001, 2.0]), (4, [-0.001, 2.0]), (250, []), (5, [9.0, 9.0, 9.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in data], SCHEMA)
    rows = df.withColumn("v", topk.scaled("embedding"))
    ints = [(r["vec_id"], r["v"]) for r in rows.collect()]
    assert sum(v is None for _, v in ints) == 5 and [-1, 512] in [v for _, v in ints]
    asks = rows.filter("vec_id % 50 = 0")
    for k in (1, 3, 20):
        assert got(topk.top_k(rows, asks, k)) == brute(ints, [r for r in ints if r[0] is not None and r[0] % 50 == 0], k)
    none = rows.limit(0)
    assert topk.top_k(none, none).count() == 0 and topk.top_k(rows, none).count() == 0 and topk.top_k(none, asks).count() == 0
    one = frame(spark, [(50, [3, 4])])
    assert got(topk.top_k(one, one)) == []


def test_hot_vector_is_folded(spark):
    """A third of all rows share one vector: no more than k + 1 of them become candidates, the answer is as if all did."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(9), F.lit(9))).otherwise(F.array(F.pmod(F.xxhash64("id"), F.lit(9)), F.lit(1))).cast("array<long>").alias("v"))
    asks = rows.filter("vec_id in (0, 9, 2999)")
    assert got(topk.top_k(rows, asks)) == brute([tuple(r) for r in rows.collect()], [tuple(r) for r in asks.collect()], 5)


def test_too_large_products_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(frame(spark, [(1, [1 << 40]), (50, [1 << 40])]), frame(spark, [(50, [1 << 40])])).collect()

"""Exact top-k inner products: vectors by descending length, partial sums in a rotated basis, residual bounds.

Vectors are lists of whole numbers. Candidates are ranged by descending length and packed into blocks of BLOCK vectors;
RUN blocks that follow each other are a stripe. Queries are dealt into groups by hash. All vectors are turned by the
right singular vectors of the candidates (from their Gram matrix, a sum over all blocks), so that the first coordinates
hold most of any inner product. Each query first meets the stripe of the longest vectors. Its k-th best score then prunes:
a stripe whose greatest length times the query's is below it (Cauchy-Schwarz) never meets the query's group, a block
inside a stripe likewise, and within a block a pair goes on from one partial sum to the next only while the sum plus
the product of the two residual lengths can still reach the k-th best. What is left is scored in whole numbers.

Of equal vectors only the k + 1 smallest ids can be among anyone's k best, so no others become candidates: copies are
folded before anything is ranged, and a vector that a third of all rows share is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.llm.shared import stored, table

#: Vectors of a block, blocks of a stripe, and queries that are compared at once.
BLOCK, RUN, ROWS = 2048, 8, 512
#: Partial sums are taken where these shares of the candidates' squared length lie before.
SHARES = (0.5, 0.8)
#: Rounding of a sum of doubles, as a part of the product of the lengths, for each dimension.
SLACK = 4e-15
PACKED = "part int, run long, seq long, length double, ids binary, wide int, dims int, data binary"


def scaled(vector: Column | str, factor: int = 256) -> Column:
    """A vector's components as floor(factor * x); null for one that is null or holds a null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(v, lambda x: F.floor(x.cast("double") * factor)))


def _pack(vectors: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in the least width that holds them."""
    top = int(np.abs(vectors).max(initial=0))
    wide = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return wide, vectors.astype(f"<i{wide}").tobytes()


def _unpacked(rows: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of packed rows, shorter vectors filled up with zeros."""
    ids, parts = [], []
    for name, wide, own, data in zip(*(rows[c].to_pylist() for c in ("ids", "wide", "dims", "data"))):
        ids.append(np.frombuffer(name, "<i8"))
        part = np.zeros((len(ids[-1]), dims), "int64")
        part[:, :own] = np.frombuffer(data, f"<i{wide}").reshape(len(ids[-1]), own)
        parts.append(part)
    return (np.concatenate(ids), np.concatenate(parts)) if ids else (np.zeros(0, "int64"), np.zeros((0, dims), "int64"))


def _blocks(rows: DataFrame, block: int = BLOCK, stripe: int = RUN) -> DataFrame:
    """Rows (grp, vec_id, v), ordered, packed: neighbours of one grp, at most block to a row; run is grp where there is one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            grp, ids, lists = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False).astype("<i8"), batch.column(2)
            sizes, flat = lists.value_lengths().to_numpy(False), lists.flatten().to_numpy(False)
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.diff(grp)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)]):
                for at in range(a, b, block):
                    own = slice(at, min(at + block, b))
                    dims = int(sizes[own].max(initial=0))
                    vectors = np.zeros((own.stop - at, dims), "int64")
                    vectors[np.arange(dims)[None, :] < sizes[own][:, None]] = flat[ends[at] - sizes[at] : ends[own.stop - 1]]
                    if int(np.abs(vectors).max(initial=0)) ** 2 * max(dims, 1) >= 1 << 62:
                        raise OverflowError("vectors whose inner products exceed 64 bits")
                    wide, data = _pack(vectors)
                    length = float(np.sqrt((vectors.astype("float64") ** 2).sum(axis=1)).max(initial=0.0))
                    run = int(grp[at]) if grp[at] >= 0 else seq // stripe
                    yield pa.RecordBatch.from_pydict(
                        {"part": pa.array([part], "int32"), "run": [run], "seq": [seq], "length": [length], "ids": [ids[own].tobytes()],
                         "wide": pa.array([wide], "int32"), "dims": pa.array([dims], "int32"), "data": [data]}
                    )
                    seq += 1

    return rows.select("grp", "vec_id", "v").mapInArrow(pack, PACKED)


def _rotation(blocks: DataFrame, dims: int) -> tuple[np.ndarray, list[int]]:
    """The candidates' right singular vectors, the strongest first, and the places of the partial sums.

    dims squared sums reach the driver, whatever the number of vectors.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            v = _unpacked(pa.Table.from_batches([batch]), dims)[1].astype("float64")
            total += v.T @ v
        yield pa.RecordBatch.from_pydict({"at": np.arange(dims * dims), "x": total.ravel()})

    total = np.zeros(dims * dims)
    for at, x in blocks.mapInArrow(gram, "at long, x double").groupBy("at").agg(F.sum("x")).collect():
        total[at] = x
    strength, basis = np.linalg.eigh(total.reshape(dims, dims))
    strength, basis = np.maximum(strength[::-1], 0), basis[:, ::-1]
    share = np.cumsum(strength) / max(strength.sum(), 1e-300)
    return basis, sorted({min(dims, int(np.searchsorted(share, s)) + 1) for s in SHARES} | {dims})


class _Best:
    """The k best of some queries so far: scores and ids, the worst at the end; need is what a pair must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.query, self.score, self.id = (np.zeros(0, "int64") for _ in range(3))
        self.need = floor.copy()

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        last = rank == self.k - 1
        self.need[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.query, self.score, self.id = q[keep], s[keep], i[keep]


def _reached(q: np.ndarray, x: np.ndarray, need: np.ndarray, stops: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) of rotated vectors whose product may reach the query's need, by partial sums."""
    slack = SLACK * (8 + q.shape[1]) * np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1))[None, :]
    total, left, at = np.zeros((len(q), len(x))), None, 0
    for stop in stops:
        rest = np.sqrt((q[:, stop:] ** 2).sum(axis=1)), np.sqrt((x[:, stop:] ** 2).sum(axis=1))
        if left is None:
            total += q[:, at:stop] @ x[:, at:stop].T
            open_ = total + rest[0][:, None] * rest[1][None, :] + slack >= need[:, None]
            if stop == stops[-1] or np.count_nonzero(open_) * 16 < open_.size:
                left = np.nonzero(open_)
                total, slack = total[left], slack[left]
        else:
            total += np.einsum("ij,ij->i", q[left[0], at:stop], x[left[1], at:stop])
            keep = total + rest[0][left[0]] * rest[1][left[1]] + slack >= need[left[0]]
            left, total, slack = (left[0][keep], left[1][keep]), total[keep], slack[keep]
        at = stop
    return left


def _met(queries: DataFrame, blocks: DataFrame, dims: int, basis: np.ndarray, stops: list[int], k: int) -> DataFrame:
    """(grp, nth, query_id, vec_id, score) of the k best, in its stripe, of each query of a group that meets the stripe.

    Both sides carry part, run and grp; queries also floors, scores that must be reached for a pair to matter.
    """

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names, asked = _unpacked(left, dims)
        floors = np.concatenate([np.frombuffer(f, "<f8") for f in left["floors"].to_pylist()] or [np.zeros(0)])
        turned = asked.astype("float64") @ basis
        length = np.sqrt((turned**2).sum(axis=1))
        best, slack = _Best(floors, k), 1 + 1e-9
        right = right.sort_by([("length", "descending"), ("seq", "ascending")])
        for b in range(right.num_rows if len(names) else 0):
            ids, vectors = _unpacked(right.slice(b, 1), dims)
            top = right["length"][b].as_py()
            alive = np.flatnonzero(length * top * slack >= best.need)
            x = vectors.astype("float64") @ basis if len(alive) else None
            for at in range(0, len(alive), ROWS):
                own = alive[at : at + ROWS]
                i, j = _reached(turned[own], x, best.need[own], stops)
                other = names[own[i]] != ids[j]
                i, j = own[i[other]], j[other]
                score = np.concatenate([np.einsum("ij,ij->i", asked[i[n : n + 65536]], vectors[j[n : n + 65536]]) for n in range(0, max(len(i), 1), 65536)])
                fit = score >= best.need[i]
                best.add(i[fit], score[fit], ids[j[fit]])
        grp = left["asked"][0].as_py()["grp"] if left.num_rows else 0
        return pa.table({"grp": np.full(len(best.query), grp), "nth": best.query, "query_id": names[best.query], "vec_id": best.id, "score": best.score})

    key = F.struct("part", "run", "grp")
    packed = ["ids", "wide", "dims", "data"]
    asked = queries.select(key.alias("asked"), "floors", *packed)
    met = blocks.select(key.alias("met"), "length", "seq", *packed)
    return asked.groupBy("asked").cogroup(met.groupBy("met")).applyInArrow(search, "grp long, nth long, query_id long, vec_id long, score long")


def _known(groups: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Packed query groups with known, the k-th best score so far of each query that has k."""
    worst = found.groupBy("grp", "nth").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") == k)
    return groups.join(worst.groupBy("grp").agg(F.collect_list(F.struct("nth", "s")).alias("known")), "grp", "left")


def _with_floors(groups: DataFrame, dims: int) -> DataFrame:
    """floors, known as packed doubles (minus infinity without one), and need, the least length that can matter to the group."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                names, vectors = _unpacked(pa.Table.from_batches([row]), dims)
                out = np.full(len(names), -np.inf)
                known = row["known"][0].as_py() if "known" in row.schema.names else None
                for x in known or ():
                    out[x["nth"]] = x["s"]
                length = np.sqrt((vectors.astype("float64") ** 2).sum(axis=1))
                need = np.where(out > 0, out / np.maximum(length, 1e-300), 0.0).min(initial=np.inf) * (1 - 1e-9)
                cols = {c: row[c] for c in ("part", "run", "seq", "length", "ids", "wide", "dims", "data", "grp")}
                yield pa.RecordBatch.from_pydict(cols | {"floors": [out.astype("<f8").tobytes()], "need": [float(need)]})

    return groups.mapInArrow(floors, PACKED + ", grp long, floors binary, need double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, per_group: int | None = None, block: int = BLOCK, stripe: int = RUN) -> DataFrame:
    """The k vectors of highest inner product with each query: query_id, rank (from 1), vec_id, score.

    Both tables have vec_id (long) and v (whole numbers, as scaled() makes them). Ties go to the smaller vec_id; a query
    isn't compared with vectors of its own id. Fewer than k others give all of them. Rows without an id or a vector take
    no part. Shorter vectors count as filled up with zeros. Rows of one id and different vectors are vectors of their own;
    repeated rows are as many candidates, and ask once. Empty tables give an empty result, other columns are ignored.
    Vectors whose products exceed 64 bits are an error. per_group, block and stripe only change how the work is cut.
    """
    spark = vectors.sparkSession
    own = [F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")]
    rows = vectors.select(*own).filter("vec_id is not null and v is not null")
    # As many of a vector's ids as could be anyone's k best; the limit works before the shuffle, too.
    least = Window.partitionBy("v").orderBy("vec_id")
    rows = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    rows = rows.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= k + 1)
    rows = rows.select(F.lit(-1).cast("long").alias("grp"), "vec_id", "v", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    order = [F.col("norm").desc(), "vec_id", "v"]
    blocks = stored(_blocks(rows.withColumn("norm", norm).repartitionByRange(*order).sortWithinPartitions(*order), block, stripe), "topk-blocks")
    asked = stored(queries.select(*own).filter("vec_id is not null and v is not null").distinct(), "topk-queries")
    seen = blocks.agg(F.max("dims").alias("dims"), F.max(F.struct("length", (-F.col("part")).alias("p"), (-F.col("run")).alias("r"))).alias("top")).first()
    n, wide = asked.count(), asked.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if not n or seen["top"] is None:
        return spark.createDataFrame([], schema)
    dims = max(seen["dims"], wide, 1)
    basis, stops = _rotation(blocks, dims)
    # Groups of queries: few enough to hold, large enough that stripes aren't read too often.
    groups = -(-n // (per_group or min(16384, max(256, n // 32))))
    dealt = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("long"))
    packed = _blocks(dealt.repartition("grp").sortWithinPartitions("grp", "vec_id", "v")).withColumn("grp", F.col("run"))
    packed = stored(_one_row(packed, dims), "topk-groups")
    asks = _with_floors(packed, dims)
    at = {"part": F.lit(-seen["top"]["p"]), "run": F.lit(-seen["top"]["r"]).cast("long")}
    first = (F.col("part") == at["part"]) & (F.col("run") == at["run"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    longest = blocks.filter(first).withColumn("grp", every)
    found = stored(_met(asks.withColumns(at), longest, dims, basis, stops, k), "topk-first")
    asks = stored(_with_floors(_known(packed, found, k), dims), "topk-asks")
    # Which stripes a group meets: by the greatest length in the stripe, every group's number set against it.
    stripes = blocks.filter(~first).groupBy("part", "run").agg(F.max("length").alias("longest")).withColumn("grp", every)
    pairs = stripes.join(asks.select("grp", "need"), "grp").filter("longest >= need").select("part", "run", "grp")
    rest = _met(asks.drop("part", "run").join(pairs, "grp"), blocks.join(pairs, ["part", "run"]), dims, basis, stops, k)
    place = Window.partitionBy("grp", "nth").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.unionByName(rest).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _one_row(packed: DataFrame, dims: int) -> DataFrame:
    """All packed rows of a group of queries as one; groups have a bounded size."""

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("seq", "ascending")])
        ids, vectors = _unpacked(rows, dims)
        wide, data = _pack(vectors)
        i32 = lambda x: pa.array([x], "int32")
        length = max(rows["length"].to_pylist())
        return pa.table({"part": i32(0), "run": [0], "seq": [0], "length": [length], "ids": [ids.tobytes()], "wide": i32(wide), "dims": i32(dims), "data": [data], "grp": rows["grp"][:1]})

    return packed.groupBy("grp").applyInArrow(joined, PACKED + ", grp long")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scaled("embedding").alias("v"))
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


QUERIES = {"op13_topk": op13_topk}

ORACLES = {
    "op13_topk": """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}

"""Connected components of a link table, with hot nodes spread over salts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofuse.plans.shared import attach, discard, salt_bit, salt_of, stored

#: Links that a task connects at once.
HELD = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The links as stars: each node with the least one that these links connect it to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low, after = np.minimum(root[a], root[b]), root.copy()
        for end in (root[a], root[b]):
            np.minimum.at(after, end, low)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_pydict({"u": nodes[own], "v": nodes[root[own]]})


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= HELD:
            yield _stars(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))
            held, size = [], 0
    if size:
        yield _stars(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))


def _contracted(edges: DataFrame) -> DataFrame:
    """What a task's downward links connect, as stars: fewer links and shorter paths, without a shuffle. Stored."""
    return stored(edges.filter("u > v").mapInArrow(_connected, "u long, v long"), "links")


def _open(edges: DataFrame) -> tuple[bool, bool]:
    """Whether a node has two roots or is one itself, and whether links repeat."""
    up, down = F.struct(F.col("u").alias("node"), "v"), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"))
    ends = edges.select(F.inline(F.array(up, down))).groupBy("node")
    ends = ends.agg(F.count("v").alias("n"), F.count(F.lit(1)).alias("all"), F.min("v").alias("x"), F.max("v").alias("y")).filter("n > 0")
    found = ends.agg(F.max((F.col("x") < F.col("y")) | (F.col("n") < F.col("all"))).alias("open"), F.max(F.col("n") > 1).alias("again")).first()
    return bool(found["open"]), bool(found["again"])


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Adds m, the least of u and its v, to each pair (u, v); rows of a hot u are spread over salts by v."""
    rows = pairs.withColumn("salt", salt_of("v"))
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    return attach(rows, least, ["u"]).withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, root), root the least id that can be reached.

    Tasks connect their own links first. Then come alternating large-star and small-star steps, one plan and one stored
    table a round, until each node has one root that has none itself: then the links are the stars of their roots. Each step
    that changes anything lowers the sum of the ends, so the end is always reached, after about the logarithm of the longest
    path squared. Loops and repeats are allowed; no links give no rows.
    """
    edges = _contracted(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")))
    while (state := _open(edges))[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        star = _least_neighbour(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        after = stored(small.filter("u > v").distinct(), "links")
        discard(edges)
        edges = _contracted(after)
        discard(after)
    if state[1]:
        once = stored(edges.distinct(), "links")
        discard(edges)
        edges = once
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

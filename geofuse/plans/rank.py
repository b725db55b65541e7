"""Exact order statistics without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofuse.plans.shared import stored

#: The most rows of a group that one task puts in order.
MOST = 1 << 17


def nth_smallest(df: DataFrame, value: str, rank: Column, by: list[str], accuracy: int = 10000, most: int = MOST) -> DataFrame:
    """Per group the value of a 0-based rank, where rank is an expression of the group's row count n.

    Groups of at most `most` rows are put in order. A larger group is narrowed in rounds: an approximate percentile
    gives two values around the rank, exact counts tell on which side of them, between them or on which of
    them the rank lies, and the next round looks at that open interval alone, a hundredth of the rows or so. Both values
    leave with each round, so ties end it, too. No task puts more than `most` rows in order. Nulls don't count.
    """
    keys = by or ["__all"]
    rows = (df if by else df.withColumn("__all", F.lit(0))).select(*keys, F.col(value).alias("v")).filter("v IS NOT NULL")
    kind = rows.schema["v"].dataType
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("k", rank.cast("long")).filter((F.col("k") >= 0) & (F.col("k") < F.col("n")))
    none = F.lit(None).cast(kind)
    groups = stored(counts.select(*keys, "k", F.col("n").alias("m"), none.alias("lo"), none.alias("hi"), none.alias("found")), "ranks")
    small, done = groups.filter(F.col("m") <= most), []
    large = groups.filter(F.col("m") > most)
    beyond = large.select(*keys)

    def inside(state: DataFrame) -> DataFrame:
        # At most one group for every `most` rows is sent to every task.
        met = rows.join(F.broadcast(state), keys)
        return met.filter((F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))

    narrowed = not large.isEmpty()
    state = large
    while narrowed:
        marks = inside(state).groupBy(*keys).agg(F.percentile_approx("v", [i / 200 for i in range(201)], accuracy).alias("marks"))
        at = F.col("k") / F.greatest(F.col("m") - 1, F.lit(1)) * 200
        low, high = F.get("marks", F.greatest(F.floor(at).cast("int") - 1, F.lit(0))), F.get("marks", F.least(F.ceil(at).cast("int") + 1, F.lit(200)))
        state = stored(state.join(marks, keys).select(*keys, "k", "m", "lo", "hi", low.alias("a"), high.alias("b")), "rank-brackets")
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        parts = {"under": v < a, "on_a": v == a, "between": (v > a) & (v < b), "on_b": (v == b) & (a < b), "over": v > b}
        seen = inside(state).groupBy(*keys, "k", "lo", "hi", "a", "b").agg(*[F.count_if(x).alias(name) for name, x in parts.items()])
        k, upto, way = F.col("k"), F.lit(0), None
        for name, lo, hi, found in (("under", F.col("lo"), a, none), ("on_a", none, none, a), ("between", a, b, none), ("on_b", none, none, b), ("over", b, F.col("hi"), none)):
            here = F.struct((k - upto).alias("k"), F.col(name).alias("m"), lo.alias("lo"), hi.alias("hi"), found.alias("found"))
            upto = upto + F.col(name)
            way = F.when(k < upto, here) if way is None else way.when(k < upto, here)
        state = stored(seen.select(*keys, way.alias("w")).select(*keys, "w.*"), "rank-rounds")
        done.append(state.filter(F.col("found").isNotNull() | (F.col("m") <= most)))
        state = state.filter(F.col("found").isNull() & (F.col("m") > most))
        narrowed = not state.isEmpty()
    met = rows.join(F.broadcast(beyond), keys, "left_anti").join(small.select(*keys, "k"), keys).select(*keys, "k", "v")
    out = []
    for part in done:
        met = met.unionByName(inside(part.filter("found IS NULL")).select(*keys, "k", "v"))
        out.append(part.filter("found IS NOT NULL").select(*keys, F.col("found").alias("v")))
    placed = met.groupBy(*keys, "k", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = placed.withColumn("upto", upto).filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k"))).select(*keys, "v")
    for part in out:
        hit = hit.unionByName(part)
    return hit.select(*by, F.col("v").alias(value))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their place (from 0) in their group's order and its size __n, without one task that sorts a group.

    Rows are dealt out in ranges, counted per range, and placed within it. They are stored on the way, so that
    both passes see the same ranges.
    """
    rows = stored(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = rows.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__c"))
    parts = Window.partitionBy(*by)  # one row per range
    before = parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(parts).alias("__n"))
    place = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)) - 1
    return rows.withColumn(name, place).join(counts, [*by, "__part"]).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def stride_sample(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Of each group at most so many rows, evenly by order: row floor(k * size / most) is the k-th."""
    r = ranked(df, by, order, "__i")
    step = F.greatest(F.col("__n") / most, F.lit(1.0))
    k = F.ceil(F.col("__i") / step)
    k = F.when(F.floor(k * step) == F.col("__i"), k)
    return r.withColumn("k", k).filter(F.col("k").isNotNull() & (F.col("k") < most)).drop("__i", "__n")

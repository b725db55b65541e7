"""As-of joins by windows: both sides in one sorted pass per key, no cross join; keys with many rows in pieces of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofuse.plans.shared import stored

#: Rows of a key that one task may put in order; the most pieces that a key is cut into; edges that are looked through at once.
PIECE, PIECES, STEP = 1 << 20, 1024, 32


def _hot(rows: DataFrame, by: list[str], t: str, piece: int) -> DataFrame | None:
    """Keys of over piece rows with edges, the times that cut them into pieces of about so many; None without such keys.

    At most one key for every piece rows, and about as many edges in all.
    """
    counts = rows.filter(F.col(t).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > piece)
    counts = stored(counts, "asof-hot")
    if counts.isEmpty():
        return None
    marks = [i / PIECES for i in range(1, PIECES)]
    times = rows.join(F.broadcast(counts), by).groupBy(*by, "__n").agg(F.percentile_approx(t, marks, 10 * PIECES).alias("__q"))
    pieces = F.least(F.ceil(F.col("__n") / piece), F.lit(PIECES)).cast("int")
    some = F.transform(F.sequence(F.lit(1), F.greatest(pieces - 1, F.lit(1))), lambda i: F.col("__q")[F.floor(i * PIECES / pieces).cast("int") - 1])
    return stored(times.select(*by, some.alias("__edges")), "asof-edges")


def _piece(t: str) -> Column:
    """The number of a time's piece: how many edges are at or before it, by every STEP-th edge first."""
    edges, at = F.col("__edges"), F.col(t)
    heads = F.transform(F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / STEP).cast("int")), lambda g: edges[g * STEP])
    g = F.size(F.filter(heads, lambda e: e <= at))
    within = F.slice(edges, F.greatest((g - 1) * STEP + 1, F.lit(1)), F.lit(STEP))
    return F.when(g == 0, 0).otherwise((g - 1) * STEP + F.size(F.filter(within, lambda e: e <= at)))


def neighbours(left: DataFrame, right: DataFrame, by: list[str], t: str, order: str, carry: list[str], piece: int = PIECE) -> DataFrame:
    """Each left row with prev and next, structs of (t, carry...) of the right rows around it, equal times in both.

    Of right rows with equal key and time the one with the least order counts. A left row without a time has neither.
    A key of more than piece rows is cut at quantiles of its times: windows run inside a piece, and the last and the first
    right row of each piece are carried over the pieces, a row each. Rows of one key and one time stay together.
    """
    once = right.filter(F.col(t).isNotNull()).groupBy(*by, t).agg(F.min(F.struct(F.col(order).alias("o"), F.struct(F.col(t).alias("t"), *[F.col(c).alias(c) for c in carry]).alias("s"))).alias("m"))
    once = once.select(*by, t, F.col("m.s").alias("s"))
    whole = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType
    rows = left.select(*by, t, F.struct(*left.columns).alias("l"), F.lit(None).cast(once.schema["s"].dataType).alias("s"))
    rows = rows.unionByName(once.select(*by, t, F.lit(None).cast(whole).alias("l"), "s"))
    hot = _hot(left.select(*by, t).unionAll(right.select(*by, t)), by, t, piece)
    keys = list(by)
    if hot is not None:
        # Both tables that are broadcast here have at most about two rows for every piece rows of the input.
        rows = rows.join(F.broadcast(hot), by, "left").withColumn("__piece", F.when(F.col("__edges").isNotNull(), _piece(t))).drop("__edges")
        keys.append("__piece")
        right_time = F.when(F.col("s").isNotNull(), F.col(t))
        ends = rows.filter("__piece IS NOT NULL").groupBy(*keys).agg(F.min_by("s", right_time).alias("__first"), F.max_by("s", right_time).alias("__last"))
        over = Window.partitionBy(*by)
        before, after = (over.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("__piece"), F.col("__piece").desc()))
        ends = ends.select(*keys, F.last("__last", ignorenulls=True).over(before).alias("__before"), F.last("__first", ignorenulls=True).over(after).alias("__after"))
        ends = stored(ends, "asof-ends")
    at = Window.partitionBy(*keys).orderBy(t)
    both = rows.withColumn("prev", F.last("s", ignorenulls=True).over(at.rangeBetween(Window.unboundedPreceding, 0)))
    # backwards, as Spark grows a frame that starts at the partition's edge but recomputes one that ends there
    back = Window.partitionBy(*keys).orderBy(F.col(t).desc()).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("next", F.last("s", ignorenulls=True).over(back)).filter("l IS NOT NULL")
    if hot is not None:
        both = both.join(F.broadcast(ends), keys, "left").withColumns({"prev": F.coalesce("prev", "__before"), "next": F.coalesce("next", "__after")})
    timed = {k: F.when(F.col(t).isNotNull(), F.col(k)) for k in ("prev", "next")}
    return both.withColumns(timed).select("l.*", "prev", "next")


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], t: str, order: str, carry: list[str], tolerance: float | None = None, piece: int = PIECE) -> DataFrame:
    """Left rows with the nearest right row's carry and dt; the earlier one on ties; none beyond the tolerance."""
    near = neighbours(left, right, by, t, order, carry, piece)
    back, ahead = F.col(t) - F.col("prev.t"), F.col("next.t") - F.col(t)
    pick = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    near = near.withColumn("__m", pick).filter("__m IS NOT NULL").withColumn("dt", F.abs(F.col(t) - F.col("__m.t")))
    if tolerance is not None:
        near = near.filter(F.col("dt") <= tolerance)
    return near.select(*left.columns, *[F.col(f"__m.{c}").alias(c) for c in carry], "dt")


def interpolated(left: DataFrame, right: DataFrame, by: list[str], t: str, order: str, values: list[str], piece: int = PIECE) -> DataFrame:
    """Left rows with right values at their time: linear between neighbours, held beyond the ends."""
    near = neighbours(left, right, by, t, order, values, piece)
    span = F.col("next.t") - F.col("prev.t")
    share = F.when(span > 0, (F.col(t) - F.col("prev.t")) / span).otherwise(0.0)

    def value(c: str):
        a, b = F.col(f"prev.{c}"), F.col(f"next.{c}")
        return F.when(F.col("prev").isNull(), b).when(F.col("next").isNull(), a).otherwise(a + (b - a) * share)

    return near.filter("prev IS NOT NULL OR next IS NOT NULL").select(*left.columns, *[value(c).alias(c) for c in values])

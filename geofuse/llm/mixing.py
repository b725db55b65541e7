"""Mixing sources to target weights by entropy balancing.

Each word starts with rate 1. Of all mixes with rates up to the cap the one closest to that in relative entropy is
taken, under a token constraint for each source and one that crosses them: the mean logarithm of the documents' sizes
by token stays what it is in the corpus, so that favouring a source of short texts doesn't shorten the mix (softly, as
caps may forbid it). So documents are tilted exponentially, rate = min(cap, exp(lambda of the source + mu * f)), f the
standardised logarithm of the size, and lambda and mu minimise the convex dual

  sum over documents of size * phi(lambda_s + mu f) - sum_s lambda_s target_s + ridge / 2 * total * mu^2,  phi' = min(cap, exp).

A Newton step takes gradient and Hessian as sums over the documents, per source; the Hessian is an arrow, one row
per source and one for mu, so only the sums of one Schur complement, a row, reach the driver. The same sums tell the
dual's value: a step that doesn't lower it enough is halved. The dual is convex, so this ends at its minimum.
Rates become whole copies by carrying the rounding error from long documents to short ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.llm.shared import salt_of, stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Passes over the sums at most (more are an error), the relative error of a constraint that ends them, and how dear the tilt by size is.
PASSES, CLOSE, RIDGE = 100, 1e-7, 0.25


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """source, size -> target. Weights repeat over the sources by code point, null last.

    Targets share all sizes by weight, stop at cap times their size, and what is above is shared again: the
    water level below which a source takes weight * level. One row per source is in these windows.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    full = ranked.withColumn("weight", weight).withColumn("most", F.col("size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        full.withColumn("total", F.sum("size").over(everything).cast("double"))
        .withColumn("taken", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("taken")) / F.col("left"))
        .withColumn("free", F.col("level") * F.col("weight") < F.col("most"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    )
    return filled.select(
        "source", "size", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("most")), F.col("most")).alias("target")
    )


def balanced(sizes: DataFrame, sources: DataFrame, cap: float, ridge: float = RIDGE, passes: int = PASSES) -> tuple[DataFrame, float]:
    """sizes (key, size, n) with the source's columns (key, source_size, target) and the dual's solution as rate; and mu.

    A source without words or target has rate 0; one whose target is all that its cap allows has the cap.
    A document without words counts as one of mean size. Raises ArithmeticError where passes don't reach the minimum; what
    CLOSE leaves open of a source's target is met in allot.
    """
    c, words = F.col, F.col("size") * F.col("n")
    log = F.log(F.greatest("size", F.lit(1)))
    whole = sizes.agg(F.sum(words).alias("total"), (F.sum(words * log) / F.sum(words)).alias("mean"), (F.sum(words * log * log) / F.sum(words)).alias("square")).first()
    total, mean = float(whole["total"] or 0), float(whole["mean"] or 0)
    spread = math.sqrt(max(0.0, float(whole["square"] or 0) - mean**2))
    f = F.when(c("size") > 0, (log - mean) / spread).otherwise(0.0) if spread > 1e-9 else F.lit(0.0)
    kind = F.when((c("source_size") <= 0) | (c("target") <= 0), "none").when(c("target") >= cap * c("source_size") * (1 - 1e-12), "all").otherwise("free")
    state = sources.withColumn("kind", kind).withColumn("lam", F.when(c("kind") == "free", F.log(c("target") / c("source_size"))).otherwise(0.0))
    state, free = state.withColumn("move", F.lit(0.0)), c("kind") == "free"
    mu, turn, length, value, slope = 0.0, 0.0, 0.0, math.inf, 0.0

    def rate(tilt: float):
        return F.when(c("kind") == "none", 0.0).when(c("kind") == "all", cap).otherwise(F.least(F.lit(cap), F.exp(c("lam") + tilt * f)))

    for _ in range(passes if total else 0):
        tilt, lam = mu + length * turn, (c("lam") + length * c("move")).alias("lam")
        at = sizes.join(state.select("key", "source_size", "target", "kind", lam), "key")
        r, u = rate(tilt), c("lam") + tilt * f
        phi = F.when(c("kind") == "none", 0.0).when(c("kind") == "all", cap * u).when(u < math.log(cap), F.exp(u)).otherwise(cap * (1 + u - math.log(cap)))
        # A document at its cap doesn't answer to the tilt; a little is left so that the Hessian stays regular, which changes steps only.
        w = F.when(free, r * F.when(r >= cap, 1e-3).otherwise(1.0)).otherwise(0.0)
        sums = at.groupBy("key", "source_size", "target", "kind", "lam").agg(
            F.sum(words * phi).alias("phi"), F.sum(words * r).alias("m"), F.sum(words * r * f).alias("mf"), F.sum(words * w).alias("h"), F.sum(words * w * f).alias("hf"), F.sum(words * w * f * f).alias("hff")
        )
        sums = stored(sums.withColumn("g", F.when(free, c("target") - c("m")).otherwise(0.0)), "mix-sums")
        one = sums.agg(
            F.sum("mf").alias("mf"), F.sum("hff").alias("hff"), F.sum(F.when(free, c("hf") * c("hf") / c("h"))).alias("cross"), F.sum(F.when(free, c("hf") * c("g") / c("h"))).alias("known"),
            F.sum(F.when(free, c("g") * c("g") / c("h"))).alias("gg"), F.sum(c("phi") - F.when(free, c("lam") * c("target")).otherwise(0.0)).alias("value"),
            F.max(F.when(free, F.abs(c("g")) / c("target"))).alias("off"),
        ).first()
        now = (one["value"] or 0.0) + ridge / 2 * total * tilt**2
        if not now <= value + 1e-4 * length * slope + 1e-12 * total:
            length /= 2
            continue
        state, mu, value = sums, tilt, now
        gradient = -(one["mf"] or 0.0) - ridge * total * mu
        if (one["off"] or 0.0) <= CLOSE and abs(gradient) <= CLOSE * total:
            break
        known = one["known"] or 0.0
        turn = (gradient - known) / ((one["hff"] or 0.0) - (one["cross"] or 0.0) + ridge * total)
        slope, length = -(one["gg"] or 0.0) + turn * known - gradient * turn, 1.0
        state = sums.withColumn("move", F.when(free, (c("g") - c("hf") * turn) / c("h")).otherwise(0.0))
    else:
        if total:
            raise ArithmeticError(f"the mix isn't balanced after {passes} passes")
    return sizes.join(state, "key").select("key", "size", "n", "source_size", "target", rate(mu).alias("rate")), mu


def _scaled(rate: np.ndarray, words: np.ndarray, target: float, cap: float) -> np.ndarray:
    """The rates times one factor, within the cap, so that they take the target exactly; Newton's last digits."""
    if not (rate * words).sum():
        return rate
    low, high = -1.0, 1.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if (np.minimum(cap, rate * math.exp(x)) * words).sum() < target else (low, x)
    return np.minimum(cap, rate * math.exp((low + high) / 2))


def allot(sizes: pd.DataFrame) -> pd.DataFrame:
    """The copies of the documents of each size, for one source: all get base, extra of them one more.

    What rounding adds or takes is carried on to the next shorter size, within 0 and cap copies. What is left at the end
    is taken up by whole copies from the longest size to the shortest, so it is less than the shortest size of which a copy
    can still be added (taken, where too much is taken); as long as moving one copy of one or two of the 400 shortest
    sizes brings it nearer, that is done, and what is left is taken up again.
    One row per distinct size: bounded by the longest document, not by the number of documents.
    """
    sizes = sizes.sort_values("size", ascending=False)
    size, n = sizes["size"].to_numpy("int64"), sizes["n"].to_numpy("int64")
    cap, target = float(sizes["cap"].iloc[0]), float(sizes["target"].iloc[0])
    rate, most = _scaled(sizes["rate"].to_numpy("float64"), (size * n).astype("float64"), target, cap), math.floor(cap)
    carry, copies = 0.0, np.zeros(len(size), "int64")
    for i in range(len(size)):
        want = rate[i] * n[i] * size[i] + carry
        copies[i] = min(max(round(want / size[i]), 0), most * n[i]) if size[i] else int(rate[i]) * n[i]
        carry = want - copies[i] * size[i]
    last, moved = np.flatnonzero(size > 0)[-400:], True
    while moved:
        carry = target - float((copies * size).sum())
        for i in np.flatnonzero(size > 0):
            more = min(max(math.trunc(carry / size[i]), -copies[i]), most * n[i] - copies[i])
            copies[i], carry = copies[i] + more, carry - more * size[i]
        up, down = last[copies[last] < most * n[last]], last[copies[last] > 0]
        moves, at = np.concatenate([[0], size[up], -size[down]]), np.concatenate([[-1], up, down])
        off = np.abs(carry - moves[:, None] - moves[None, :])
        off[at[:, None] == at[None, :]] = np.inf
        off[0, 0] = abs(carry)
        pair = [k for k in np.unravel_index(off.argmin(), off.shape) if k]
        for k in pair:
            copies[at[k]] += 1 if k <= len(up) else -1
        moved = bool(pair)
    return sizes.assign(base=copies // n, extra=copies % n)[["key", "size", "source_size", "target", "rate", "base", "extra"]]


def _keys(docs: DataFrame) -> list[Column]:
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return [key.alias("key"), word_count(F.col("text")).alias("size"), salt_of("doc_id").alias("salt")]


def plan(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, key, size, salt) of each document -> the copies of each (key, size, salt): base, and extra that get one more."""
    cap = float(cap)
    counts = stored(sizes.groupBy("source", "key", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    totals = counts.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
    sources = targets(totals.select("source", "size"), weights, cap).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), F.col("size").alias("source_size"), "target"
    )
    by_size = stored(counts.groupBy("key", "size").agg(F.sum("n").alias("n")), "mix-by-size")
    rates, _ = balanced(by_size, stored(sources, "mix-targets"), cap)
    rates = rates.withColumn("cap", F.lit(cap))
    extra = rates.groupBy("key").applyInPandas(allot, "key string, size long, source_size long, target double, rate double, base long, extra long")
    # The extra copies of one size go to its salts in order, so that only one salt is divided.
    before = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.join(extra, ["key", "size"])
        .withColumn("given", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("key", "size", "salt", "source_size", "target", "rate", "base", F.least(F.greatest(F.col("extra") - F.col("given"), F.lit(0)), F.col("n")).alias("extra"))
    )


def _copied(rows: DataFrame, planned: DataFrame, *ties: str) -> DataFrame:
    """Rows with doc_id, key, size and salt, and their copies; ties order rows of one doc_id."""
    place = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", *ties))
    out = rows.withColumn("place", place).join(planned, ["key", "size", "salt"])
    return out.withColumn("copies", (F.col("base") + (F.col("place") <= F.col("extra")).cast("int")).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, rate.

    A null text has size 0 and takes 0; a null source is a source of its own, the last. Repeated ids are
    separate rows; which of several equal rows gets the extra copy makes no difference. An empty table gives
    an empty result. Reruns agree: the choice goes by a hash of doc_id. Other columns are ignored.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *_keys(docs)), "mix-sizes")
    out = _copied(rows, plan(rows, weights, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The mix itself: docs' own columns, each row as often as mix() says. Blank texts take no words and stay out."""
    planned = plan(docs.select("source", *_keys(docs)), weights, cap)
    rows = docs.select("doc_id", *_keys(docs), F.struct(*docs.columns).alias("doc"), F.sha1("text").alias("h"))
    out = _copied(rows, planned, "h").filter("copies > 0 AND size > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


QUERIES = {"op4_mixing": op4_mixing}

"""Event streams: gauges, nearest matches between streams, newest exports; run status and queue progress are in stateful.

Each function takes a streaming (or batch) DataFrame and gives one: the caller picks source and sink. Event time
rules, which decide between late and repeated events, are stated in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.plans.shared import new_dir

c = F.col


def gauge_windows(obs: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "30 minutes") -> DataFrame:
    """Per site and parameter count, mean and greatest value of tumbling or sliding windows; later rows than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = obs.withWatermark("ts", watermark).groupBy(w.alias("w"), "site_no", "parameter_cd")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(c("w.start").alias("start"), "site_no", "parameter_cd", "n", "mean", "most")


def gauge_sessions(obs: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Per site runs of readings without a gap."""
    g = obs.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "site_no")
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")).select(c("w.start").alias("start"), c("w.end").alias("end"), "site_no", "n", "most")


def within(left: DataFrame, right: DataFrame, by: str, seconds: float, watermark: str = "10 minutes") -> DataFrame:
    """Pairs of a left row (ts) and the right rows (rts) of its key that are near in time: an interval join with bounded state.

    Rows meet by key and by a stretch of time four times as long as seconds; right rows go to every stretch that they can reach, one or
    two. So the rows of one key are spread over tasks by their times.
    """
    cell = int(seconds * 4e6)
    left = left.withWatermark("ts", watermark).withColumn("_cell", F.floor(F.unix_micros("ts") / cell)).alias("l")
    reach = [F.floor((F.unix_micros("rts") + F.lit(d * int(seconds * 1e6))) / cell) for d in (-1, 1)]
    right = right.withWatermark("rts", watermark).withColumn("_cell", F.explode(F.array_distinct(F.array(*reach)))).alias("r")
    span = F.make_dt_interval(secs=F.lit(seconds))
    near = (c(f"l.{by}") == c(f"r.{by}")) & (c("l._cell") == c("r._cell")) & (c("r.rts") >= c("l.ts") - span) & (c("r.rts") <= c("l.ts") + span)
    keep = [c(f"r.{k}") for k in right.columns if k not in (by, "_cell")]
    return left.join(right, near).select(*[c(f"l.{k}") for k in left.columns if k != "_cell"], *keep)


def nearest_of(pairs: DataFrame, key: str, order: str) -> DataFrame:
    """Of the pairs of a left row the nearest in time, the earlier on ties, then the least order."""
    dt = F.abs(F.unix_micros("rts") - F.unix_micros("ts"))
    return pairs.groupBy(key).agg(F.min(F.struct(dt.alias("dt_us"), "rts", order)).alias("m")).select(key, "m.*")


def newest_export(paths: DataFrame, column: str = "path") -> DataFrame:
    """The greatest iteration among files named export_<iteration>.ply, per folder; others don't count."""
    n = F.regexp_extract(column, r"(?:^|/)export_(\d{1,9})\.ply$", 1)
    folder = F.regexp_replace(column, r"[^/]*$", "")
    return paths.select(folder.alias("folder"), n.alias("n")).filter("n <> ''").groupBy("folder").agg(F.max(c("n").cast("int")).alias("iteration"))


def replayed(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what is there now and reads its result: complete and append tables, or the last row of each key of updates."""
    spark: SparkSession = stream.sparkSession
    path, state = new_dir(spark, "replay"), new_dir(spark, "replay-state")

    def put(batch: DataFrame, nth: int) -> None:
        batch.withColumn("_batch", F.lit(nth)).write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(f"{_ddl(stream)}, _batch int").parquet(path)
    if mode == "update":
        last = Window.partitionBy(*keys).orderBy(c("_batch").desc())
        out = out.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")
    return out.drop("_batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

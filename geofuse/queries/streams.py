"""Streams replayed over the events table: the same plan as live, with a batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.queries.registry import query, r
from geofuse.streaming import events as st
from geofuse.streaming import stateful as sf_

c = F.col
US = "epoch_us(ts)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream, with real timestamps."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", c("ts").cast("timestamp"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(c("event_id") % 17 == 0, "done").when(c("event_id") % 23 == 0, "failed").otherwise("progress")
    return events(spark, sf).select("ts", "event_id", c("user_id").alias("run"), kind.alias("kind"), (c("value") / 100).alias("progress"), c("event_type").alias("detail"))


RUNS = f"e AS (SELECT {US} AS us, event_id, user_id AS run, CASE WHEN mod(event_id, 17) = 0 THEN 'done' WHEN mod(event_id, 23) = 0 THEN 'failed' ELSE 'progress' END AS kind, value / 100e0 AS progress, event_type AS detail FROM events)"


@query("t1_run_status", q=f"WITH {RUNS} SELECT run, us, event_id, kind, round(progress, 6) AS progress, detail, n AS events FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY us DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY run) AS n FROM e) x WHERE k = 1")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    with sf_.state_store(spark):
        s = st.replayed(sf_.run_status(runs(spark, sf)), "update", ("run",))
    return s.withColumn("progress", r("progress"))


@query("t2_queue_progress", q=f"""WITH {RUNS}, l AS (SELECT run, detail, CASE WHEN kind = 'done' THEN 1e0 ELSE greatest(0e0, least(1e0, progress)) END AS p, row_number() OVER (PARTITION BY run ORDER BY us DESC, event_id DESC) AS k FROM e),
t AS (SELECT run, kind, row_number() OVER (PARTITION BY run ORDER BY us DESC, event_id DESC) AS k FROM e WHERE kind <> 'progress') SELECT l.run AS item, round(p, 6) + 0e0 AS progress, detail, coalesce(t.kind, 'running') AS state FROM l LEFT JOIN t ON t.run = l.run AND t.k = 1 WHERE l.k = 1""")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    with sf_.state_store(spark):
        q = st.replayed(sf_.queue_progress(runs(spark, sf)), "update", ("item",))
    return q.select("item", r("progress").alias("progress"), "detail", "state")


def gauges(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(c("event_id") % 2 == 0, "00060").otherwise("00065")
    return events(spark, sf).select("ts", (c("user_id") % 40).alias("site_no"), p.alias("parameter_cd"), "value")


@query("t5_gauges_tumbling", q=f"SELECT CAST(floor({US} / 3600e6) * 3600 AS BIGINT) AS start_s, mod(user_id, 40) AS site_no, CASE WHEN mod(event_id, 2) = 0 THEN '00060' ELSE '00065' END AS parameter_cd, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY ALL")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    g = st.replayed(st.gauge_windows(gauges(spark, sf)), "complete")
    return g.select(F.unix_seconds("start").alias("start_s"), "site_no", "parameter_cd", "n", r("mean").alias("mean"), r("most").alias("most"))


@query("t5_gauges_sliding", q=f"SELECT CAST((floor({US} / 1800e6) - o) * 1800 AS BIGINT) AS start_s, mod(user_id, 40) AS site_no, CASE WHEN mod(event_id, 2) = 0 THEN '00060' ELSE '00065' END AS parameter_cd, count(*) AS n, round(max(value), 6) AS most FROM events, range(0, 2) z(o) GROUP BY ALL")
def t5_sliding(spark: SparkSession, sf: str) -> DataFrame:
    g = st.replayed(st.gauge_windows(gauges(spark, sf), "1 hour", "30 minutes"), "complete")
    return g.select(F.unix_seconds("start").alias("start_s"), "site_no", "parameter_cd", "n", r("most").alias("most"))


@query("t5_gauges_session", q=f"""WITH g AS (SELECT {US} AS us, mod(user_id, 40) AS site_no, value FROM events), m AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY site_no ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS new FROM g),
s AS (SELECT *, sum(new) OVER (PARTITION BY site_no ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT min(us) AS start_us, max(us) + 1800000000 AS end_us, site_no, count(*) AS n, round(max(value), 6) AS most FROM s GROUP BY site_no, k""")
def t5_session(spark: SparkSession, sf: str) -> DataFrame:
    g = st.replayed(st.gauge_sessions(gauges(spark, sf)), "complete")
    return g.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "site_no", "n", r("most").alias("most"))


@query("t6_stream_georeference", "fx_telemetry", "fx_frame", q="""SELECT frame_id, sample_id, CAST(round(dt * 1e6) AS BIGINT) AS dt_us FROM (SELECT f.frame_id, t.sample_id, abs(f.unix_s - t.unix_s) AS dt, row_number() OVER (PARTITION BY f.frame_id ORDER BY abs(f.unix_s - t.unix_s), t.unix_s, t.sample_id) AS k
FROM fx_frame f JOIN fx_telemetry t ON f.track_id = t.track_id WHERE abs(f.unix_s - t.unix_s) <= 3600) x WHERE k = 1""")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    """Frames and fixes as two streams, joined within an hour; the nearest of what the join kept."""
    frames = events(spark, sf).filter("event_type = 'click'").select("ts", c("event_id").alias("frame_id"), c("user_id").alias("track_id"))
    fixes = events(spark, sf).filter("event_type <> 'click'").select(c("ts").alias("rts"), c("event_id").alias("sample_id"), c("user_id").alias("track_id"))
    pairs = st.replayed(st.within(frames, fixes, "track_id", 3600.0), "append")
    return st.nearest_of(pairs, "frame_id", "sample_id").select("frame_id", "sample_id", "dt_us")


@query("t3_stream_validation", q=f"""WITH e AS (SELECT {US} AS us, event_id, user_id AS run, event_type, value FROM events), j AS (SELECT p.event_id AS preview_id, k.event_id AS ckpt_id, abs(p.us - k.us) AS dt_us, k.us AS kus, abs(p.value - k.value) AS d,
 row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.us - k.us), k.us, k.event_id) AS q FROM e p JOIN e k ON p.run = k.run WHERE p.event_type <> 'purchase' AND k.event_type = 'purchase' AND abs(p.us - k.us) <= 1800000000)
SELECT preview_id, ckpt_id, dt_us, CASE WHEN d <= 35e0 THEN 'validated' ELSE 'diverged' END AS state FROM j WHERE q = 1""")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    """Preview statistics against the checkpoints that arrive within half an hour of them."""
    e = events(spark, sf)
    preview = e.filter("event_type <> 'purchase'").select("ts", c("event_id").alias("preview_id"), c("user_id").alias("run"), c("value").alias("pv"))
    ckpt = e.filter("event_type = 'purchase'").select(c("ts").alias("rts"), c("event_id").alias("ckpt_id"), c("user_id").alias("run"), c("value").alias("cv"))
    pairs = st.replayed(st.within(preview, ckpt, "run", 1800.0), "append").withColumn("ck", F.struct("ckpt_id", F.abs(c("pv") - c("cv")).alias("d")))
    n = st.nearest_of(pairs, "preview_id", "ck")
    return n.select("preview_id", "ck.ckpt_id", "dt_us", F.when(c("ck.d") <= 35.0, "validated").otherwise("diverged").alias("state"))


@query("t4_newest_export", q="SELECT '/w' || mod(event_id, 7) || '/' AS folder, CAST(max(event_id) AS INT) AS iteration FROM events WHERE mod(event_id, 3) = 0 GROUP BY 1")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    """File names as they land in seven folders."""
    name = F.when(c("event_id") % 3 == 0, F.format_string("/w%d/export_%d.ply", c("event_id") % 7, "event_id")).otherwise(F.format_string("/w%d/other_%d.ply", c("event_id") % 7, "event_id"))
    return st.replayed(st.newest_export(events(spark, sf).select(name.alias("path"))), "complete")


@query("t4_stable_exports", q="""WITH p AS (SELECT '/w' || mod(event_id, 7) AS folder, event_id // 7 AS poll, event_id // 7 // 5 AS iteration, 100 * (1 + least((event_id // 7) % 5, (event_id // 7 // 5 * 7 + mod(event_id, 7)) % 6)) AS bytes FROM events),
l AS (SELECT *, lag(iteration) OVER w AS i0, lag(bytes) OVER w AS b0 FROM p WINDOW w AS (PARTITION BY folder ORDER BY poll))
SELECT folder, CAST(iteration AS INT) AS iteration, CAST(any_value(bytes) AS BIGINT) AS bytes, CAST(min(poll) AS BIGINT) AS poll FROM l WHERE iteration = i0 AND bytes = b0 GROUP BY folder, iteration""")
def t4_stable(spark: SparkSession, sf: str) -> DataFrame:
    """Seven folders, a poll an event: a new export every fifth poll, which grows for up to five polls; some never come to rest."""
    poll, folder = F.floor(c("event_id") / 7), c("event_id") % 7
    iteration = F.floor(poll / 5)
    grown = F.least(poll % 5, (iteration * 7 + folder) % 6)
    name, path = F.format_string("/w%d", folder), F.format_string("/w%d/export_%d.ply", folder, iteration)
    polls = events(spark, sf).select(poll.alias("poll"), name.alias("folder"), iteration.cast("int").alias("iteration"), path.alias("path"), (100 * (1 + grown)).cast("long").alias("bytes"))
    with sf_.state_store(spark):
        return st.replayed(sf_.stable_exports(polls), "append").select("folder", "iteration", "bytes", "poll")

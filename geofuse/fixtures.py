"""Views that derive every operator's input from the given tables, in Spark and DuckDB from one text.

{US(x)} is microseconds since the epoch, {AT(a,i)} the i-th element of an array from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_telemetry": """
SELECT user_id AS track_id, event_id AS sample_id, {US(ts)} / 1e6 AS unix_s,
       174.7e0 + mod(user_id * 7919 + event_id, 10007) / 1e5 AS lon_deg,
       -41.3e0 + mod(event_id * 104729, 10009) / 1e5 AS lat_deg,
       20e0 + value / 10e0 AS height_m,
       CASE event_type WHEN 'purchase' THEN 0.05e0 WHEN 'signup' THEN 0.5e0 ELSE 2e0 END AS std_e,
       CASE event_type WHEN 'purchase' THEN 0.05e0 WHEN 'signup' THEN 0.5e0 ELSE 2e0 END AS std_n,
       CASE event_type WHEN 'purchase' THEN 0.1e0 ELSE 5e0 END AS std_u,
       event_type AS source
FROM events WHERE event_type <> 'click'
""",
    "fx_frame": """
SELECT user_id AS track_id, event_id AS frame_id, {US(ts)} / 1e6 AS unix_s FROM events WHERE event_type = 'click'
""",
    "fx_gcp": """
SELECT mod(s_suppkey, 3) AS group_id, s_suppkey AS gcp_id,
       lx, ly, lz,
       1.02e0 * (0.8660254037844387e0 * lx - 0.5e0 * ly) + 12e0 + nz AS qx,
       1.02e0 * (0.5e0 * lx + 0.8660254037844387e0 * ly) - 7e0 - nz AS qy,
       1.02e0 * lz + 3e0 AS qz
FROM (SELECT s_suppkey, mod(s_suppkey * 37, 101) * 1e0 AS lx, mod(s_suppkey * 53, 89) * 1e0 AS ly,
             mod(s_suppkey * 71, 13) * 1e0 AS lz,
             CASE WHEN mod(s_suppkey, 29) = 7 THEN 4e0 ELSE s_acctbal / 1e6 END AS nz FROM supplier) s
""",
    "fx_aoi": """
SELECT n_nationkey AS aoi_id, -180e0 + mod(n_nationkey * 67, 340) AS west, -70e0 + mod(n_nationkey * 41, 130) AS south,
       -180e0 + mod(n_nationkey * 67, 340) + 6e0 + mod(n_nationkey, 7) AS east,
       -70e0 + mod(n_nationkey * 41, 130) + 5e0 + mod(n_nationkey, 5) AS north
FROM nation
""",
    "fx_site": """
SELECT c_custkey AS site_id, -180e0 + mod(c_custkey * 48271, 360000) / 1e3 AS lon, -80e0 + mod(c_custkey * 16807, 160000) / 1e3 AS lat
FROM customer
""",
    "fx_gauge_obs": """
SELECT event_id AS obs_id, mod(user_id, 40) AS site_no, ts, CASE WHEN mod(event_id, 2) = 0 THEN '00060' ELSE '00065' END AS parameter_cd, value
FROM events
""",
    "fx_bed": """
SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col,
       4.2e0 - yn * 3.4e0 + (xn - 0.5e0) * (xn - 0.5e0) * 1.8e0
       - exp(-((xn - 0.42e0 - yn * 0.18e0) * (xn - 0.42e0 - yn * 0.18e0)) / 0.012e0) * 1.6e0
       - exp(-((xn - 0.62e0) * (xn - 0.62e0) + (yn - 0.55e0) * (yn - 0.55e0)) / 0.02e0) * 0.9e0
       + CASE WHEN abs(xn - 0.55e0) < 0.03e0 AND yn > 0.35e0 AND yn < 0.7e0 THEN 1.1e0 ELSE 0e0 END AS z
FROM (SELECT r, c, c / 95e0 AS xn, r / 71e0 AS yn FROM range(0, 72) a(r) CROSS JOIN range(0, 96) b(c)) g
""",
    "fx_depth_ts": """
SELECT l_returnflag AS run_id, CAST(l_linenumber AS BIGINT) * 900 AS t_s, mod(l_partkey, 16) AS row, mod(l_orderkey, 24) AS col,
       round(greatest(0e0, (avg(l_quantity) - 22e0) / 5e0), 6) AS h,
       round(avg(l_discount) * 10e0, 6) AS u, round(avg(l_tax) * 10e0 - 0.4e0, 6) AS v
FROM lineitem GROUP BY l_returnflag, l_linenumber, mod(l_partkey, 16), mod(l_orderkey, 24)
""",
    "fx_evidence": """
SELECT l_returnflag AS source, l_quantity / 10e0 AS x, l_extendedprice / 1e4 AS y, l_discount * 50e0 AS z,
       mod(l_partkey, 256) AS r, mod(l_suppkey * 7, 256) AS g, mod(l_orderkey, 256) AS b,
       round(1e0 - l_tax * 11e0, 2) AS confidence, (l_linestatus = 'O' AND l_linenumber = 1) AS preserve
FROM lineitem
""",
    "fx_splat": """
SELECT o_orderkey AS splat_id, mod(o_orderkey * 31, 997) / 100e0 AS x, mod(o_custkey * 17, 499) / 100e0 AS y, mod(o_orderkey * 7, 211) / 100e0 AS z,
       ln(0.02e0 + mod(o_orderkey, 11) / 100e0) AS s0, ln(0.02e0 + mod(o_orderkey, 7) / 100e0) AS s1, ln(0.02e0 + mod(o_orderkey, 5) / 100e0) AS s2,
       ln((0.02e0 + mod(o_orderkey, 97) / 100e0) / (0.98e0 - mod(o_orderkey, 97) / 100e0)) AS opacity_logit,
       1e0 AS qw, mod(o_orderkey, 13) / 20e0 AS qx, mod(o_orderkey, 17) / 30e0 AS qy, mod(o_orderkey, 19) / 40e0 AS qz,
       (mod(o_orderkey, 256) / 255e0 - 0.5e0) / 0.28209479e0 AS dc0, (mod(o_custkey, 256) / 255e0 - 0.5e0) / 0.28209479e0 AS dc1,
       (mod(o_orderkey + o_custkey, 256) / 255e0 - 0.5e0) / 0.28209479e0 AS dc2
FROM orders
""",
    "fx_view": """
SELECT CAST(i AS BIGINT) AS image_id, CAST(mod(i, 2) AS BIGINT) AS camera_id, 1e0 AS qw, 0e0 AS qx, 0e0 AS qy, 0e0 AS qz,
       -(i * 0.8e0) AS tx, -2.5e0 AS ty, 4e0 + mod(i, 3) AS tz, CASE WHEN mod(i, 2) = 0 THEN 800e0 ELSE 650e0 END AS f,
       640e0 AS width, 480e0 AS height
FROM range(0, 12) t(i)
""",
    "fx_obs": """
SELECT l_returnflag AS solver, mod(l_orderkey, 60) AS image_id, l_partkey AS point_id, min(l_discount) * 60e0 AS err_px
FROM lineitem GROUP BY l_returnflag, mod(l_orderkey, 60), l_partkey
""",
    "fx_bits": """
SELECT vec_id AS kp_id, mod(vec_id, 4) AS frame_id, CAST(i AS INT) AS bit, CASE WHEN {AT(embedding,i)} > 0 THEN 1 ELSE 0 END AS v
FROM embeddings CROSS JOIN range(0, 64) t(i)
""",
    "fx_pixel": """
SELECT vec_id AS image_id, CAST(floor(i / 8e0) AS INT) AS y, CAST(mod(i, 8) AS INT) AS x, round(128e0 + 300e0 * {AT(embedding,i)}) AS g
FROM embeddings CROSS JOIN range(0, 64) t(i)
""",
    "fx_triangle": """
SELECT p_partkey AS tri_id, p_partkey AS v0, p_partkey + 1 AS v1, p_partkey + 2 AS v2, CAST(floor(p_partkey / 23e0) AS BIGINT) AS truth_component
FROM part WHERE mod(p_partkey, 23) <= mod(CAST(floor(p_partkey / 23e0) AS BIGINT), 20)
""",
    "fx_checkpoint": """
SELECT mod(o_orderkey, 3) AS run_no, o_orderkey AS ckpt_id, mod(o_orderkey * 389, 43200) * 1e0 AS time_s,
       mod(o_orderkey, 23) / 10e0 AS max_depth_m, mod(o_orderkey, 90) / 100e0 AS wet_fraction, o_totalprice AS mass_m3
FROM orders WHERE mod(o_orderkey, 20) = 0
""",
    "fx_hydrograph": """
SELECT mod(user_id, 40) AS series_id, event_id AS sample_id, ({US(ts)} / 1e6 - 1704067200e0) / 3600e0 AS hours, value / 100e0 AS stage_m, value / 4e0 AS discharge_cms
FROM events
""",
}


def text_for(name: str, spark: bool) -> str:
    text = VIEWS[name]
    if spark:
        text = re.sub(r"\{US\((\w+)\)\}", r"unix_micros(CAST(\1 AS TIMESTAMP))", text)
        return re.sub(r"\{AT\((\w+),(\w+)\)\}", r"\1[CAST(\2 AS INT)]", text)
    text = re.sub(r"\{US\((\w+)\)\}", r"epoch_us(\1)", text)
    return re.sub(r"\{AT\((\w+),(\w+)\)\}", r"\1[\2 + 1]", text)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the given tables, read from parquet where they are."""
    names = "|".join(TABLES)
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({names})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, text_for(name, spark=True))


def oracle(*names: str, q: str) -> str:
    """DuckDB SQL with the named views in front."""
    if not names:
        return q
    head = ",\n".join(f"{n} AS ({text_for(n, spark=False)})" for n in names)
    q, kind = q.strip(), "WITH"
    if q.startswith("WITH RECURSIVE "):
        q, kind = "WITH " + q[15:], "WITH RECURSIVE"
    return f"{kind} {head},\n{q[5:]}" if q.startswith("WITH ") else f"{kind} {head}\n{q}"

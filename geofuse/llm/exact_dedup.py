"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Rows are combined three times, each time on the digest *and* the full content: inside each map task, then
in groups of (salt, digest), then over the salts. So equal digests never merge different texts. What is
handed back to the rows is a narrow table of winners, joined on (digest, salt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.llm.shared import attach, salt_bit, salt_of, stored, table

WHITE = " \t\n\x0b\x0c\r"
#: A winner's rank is length * SHIFT + (2^63 - doc_id), one decimal, so that max() keeps to hash aggregation.
SHIFT = "100000000000000000000"
TOP = "9223372036854775808"


def without_white(text: Column) -> Column:
    for ch in WHITE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def _rank(length: Column, doc_id: Column) -> Column:
    tail = F.coalesce(F.lit(TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return (length.cast("decimal(12,0)") * F.lit(SHIFT).cast("decimal(21,0)") + tail).cast("decimal(38,0)")


def _winner(rank: Column) -> Column:
    tail = rank % F.lit(SHIFT).cast("decimal(21,0)")
    return F.when(tail > 0, F.lit(TOP).cast("decimal(38,0)") - tail).cast("long")


def exact_dedup(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Ties in length go to the smallest doc_id; a null doc_id loses to any other,
    and a group of null ids alone keeps all its rows with keep_id null. Rows that repeat a winning doc_id
    are all marked kept. digest_bits shortens the grouping digest (tests force collisions with it).
    An empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("len"), without_white(text).alias("norm")
    ).select("doc_id", "len", "norm", F.sha2("norm", 256).alias("sha"), salt_of("doc_id", "len").alias("salt"))
    base = base.withColumn("digest", F.unhex(F.substring("sha", 1, digest_bits // 4)))

    salted = base.groupBy("salt", "digest", "norm").agg(
        F.max(_rank(F.col("len"), F.col("doc_id"))).alias("rank"), F.count(F.lit(1)).alias("n")
    )
    merged = (
        salted.withColumn("bit", salt_bit(F.col("salt")))
        .repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("rank").alias("rank"), F.sum("n").alias("n"), F.bit_or("bit").alias("salts"))
    )
    groups = stored(
        merged.select("digest", F.sha2("norm", 256).alias("sha"), "rank", "n", "salts")
        .withColumn("contents", F.count(F.lit(1)).over(Window.partitionBy("digest"))),
        "exact-groups",
    )
    # A digest with one content names its content; only digests that collide need the content again.
    rows = base.select("doc_id", "digest", "sha", "salt")
    alone = groups.filter("contents = 1").select("digest", "rank", "n", "salts")
    out = attach(rows, alone, ["digest"])
    crowded = groups.filter("contents > 1")
    if not crowded.isEmpty():
        again = merged.join(crowded.select("digest").distinct(), "digest", "left_semi")
        out = out.unionByName(
            attach(base.select("doc_id", "digest", "sha", "salt", "norm"), again, ["digest", "norm"]).drop("norm")
        )
    keep = _winner(F.col("rank"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS len,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents) d
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {"op3_exact_dedup": SQL}

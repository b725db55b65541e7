"""SimHash near-duplicates with pivot distance tables.

A table holds each distinct fingerprint's Hamming distances to many reference fingerprints (pivots). Pivots
are zero and patterns that live in one of five blocks of bits. Fingerprints that differ in two bits or fewer
agree in three whole blocks, so their distances to those blocks' pivots, less the distance to zero, are equal:
that is the join key, ten choices of blocks in all, and it loses no link. Of the pairs that meet, those whose
largest coordinate difference is over two are discarded, and the rest are verified on the fingerprints.
Work goes by distinct fingerprint; copies of one text never meet. AQE splits a key that many fingerprints share.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.llm.shared import attach, salt_bit, salt_of, small_batches, stored, table
from geofuse.llm.word_hashes import hashed
from geofuse.plans.components import components

BLOCKS = (13, 13, 13, 13, 12)
#: Bits of so many hashes are counted at a time, which bounds memory for any length of text.
STEP = 1 << 16


def _bits(h: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero without hashes."""
    ones = np.zeros(64, "int64")
    for at in range(0, len(h), STEP):
        ones += np.unpackbits(h[at : at + STEP].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's shingles; zero without words."""
    return next(_bits(h) for _, h in hashed([text], words))


def fingerprints(words: int):
    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([_bits(h) for _, h in hashed(texts, words)], dtype="uint64").view("int64"), dtype="int64")

    return signed


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(per_block: int = 8) -> list[list[int]]:
    """Reference patterns of each block: its bits by the binary digits of their place, then random halves."""
    out, start = [], 0
    rng = np.random.default_rng(11)
    for width in BLOCKS:
        places = range(width)
        own = [sum(1 << (start + i) for i in places if i >> d & 1) for d in range(width.bit_length())]
        while len(own) < per_block:
            own.append(sum(1 << (start + int(i)) for i in rng.permutation(width)[: width // 2]))
        out.append(own)
        start += width
    return out


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, at most bits (0 to 2) apart."""
    blocks = pivots()
    flat = [0, *itertools.chain(*blocks)]

    def table_of(fp: Column) -> Column:
        return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("byte") for p in flat])

    codes = []
    for own in blocks:
        codes.append(F.xxhash64(*[(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))) - F.bit_count("fp")).cast("int") for p in own]))
    choices = [F.xxhash64(F.lit(c), *[codes[i] for i in three]) for c, three in enumerate(itertools.combinations(range(5), 3))]
    # Only fingerprint and key are shuffled; the tables of what meets are made again from the fingerprints.
    keyed = fps.select("fp", F.explode(F.array(*choices)).alias("key"))
    a, b = keyed.select(F.col("fp").alias("a"), "key"), keyed.select(F.col("fp").alias("b"), "key")
    met = a.join(b, "key").filter("a < b").select("a", "b")
    apart = F.zip_with(table_of(F.col("a")), table_of(F.col("b")), lambda x, y: F.abs(x - y))
    near = met.filter(F.forall(apart, lambda x: x <= bits)).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return near.distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id, n_links of its fingerprint, h (hash of its text), root.

    root is the group's own key: the least fingerprint of its links, or the only one. component_id can't be that
    key where ids are null or repeat.
    component_id is the smallest doc_id of the documents reachable by links, itself included. Null and blank
    texts have fingerprint zero and link like any other. A null doc_id takes part, but is never an id unless
    its whole group is null. Repeated ids are separate rows. An empty table gives an empty result.
    """
    fp = fingerprints(words)
    small_batches(docs.sparkSession)
    own = [F.col("doc_id").cast("long").alias("doc_id"), fp(F.col("text").cast("string")).alias("fp"), F.xxhash64("text").alias("h")]
    rows = docs.select(*own)
    rows = stored(rows.withColumn("salt", salt_of("doc_id")), "simhash-rows")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    fps = stored(fps, "simhash-fps")
    pairs = stored(links(fps, bits), "simhash-links")
    members = components(pairs).join(fps.select(F.col("fp").alias("node"), "least"), "node").withColumn("salt", salt_of("node"))
    roots = members.groupBy("root").agg(F.min("least").alias("component"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    named = attach(members.select("node", "root", "salt"), roots, ["root"]).select(F.col("node").alias("fp"), "root", "component")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    known = fps.join(named, "fp", "left").join(degree, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "salts"
    )
    return attach(rows, known, ["fp"]).select("doc_id", "fp", "component_id", "n_links", "h", "root")


def one_of_each(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id, of equal rows one.

    A row with a null doc_id stays only where its whole group has none; then one text of the group stays.
    """
    return kept_of(docs, near_duplicates(docs, words, bits))


def kept_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that stay of groups (doc_id, component_id, h, root), one of each root."""
    kept = groups.filter("doc_id <=> component_id")
    kept = kept.groupBy("root", "doc_id").agg(F.min("h").alias("h")).select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), F.col("h").alias("k_h"))
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), F.xxhash64("text").alias("k_h"),
    )
    met = rows.join(kept, ["k_id", "k_null", "k_h"], "left_semi")
    first = F.row_number().over(Window.partitionBy("k_id", "k_null", "k_h").orderBy("k_h"))
    return met.withColumn("first", first).filter("first = 1").select("doc.*")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id", "n_links")


QUERIES = {"op8_simhash": op8_simhash}

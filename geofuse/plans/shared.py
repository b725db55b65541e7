"""The shared work folder, and joins that survive hot keys."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Salts a key is split into; the salts a group has seen fit the 64 bits of one long.
SALTS = 64
_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one, if master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="geofuse-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{_scratch.get() or work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder by the file system that Spark has for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all that is stored inside the block, removed at its end: results must be written by then."""
    folder = f"{work_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut in the lineage that outlives executors."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def settled(df: DataFrame) -> DataFrame:
    """The same rows; what was computed so far is computed once, not written out again in all that uses it."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def few(df: DataFrame, most: int = 20000, what: str = "rows") -> DataFrame:
    """A table to be sent to every task, counted first: more rows than most are an error."""
    if df.count() > most:
        raise ValueError(f"too many {what} to send to every task: split them, most {most}")
    return F.broadcast(df)


def salt_of(*cols: Column | str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salt_bit(salt: Column) -> Column:
    """A salt as one bit, so that a group can gather its salts with bit_or, a fixed-width aggregate."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), salt)


def per_salt(groups: DataFrame, bits: str = "salts", salt: str = "salt", salts: int = SALTS) -> DataFrame:
    """A row of a group for each salt whose bit it has: at most 64, however many rows the group holds."""
    seen = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit(F.col(bits), s) == 1)
    return groups.withColumn(salt, F.explode(seen)).drop(bits)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], salt: str = "salt", how: str = "inner") -> DataFrame:
    """Joins rows (with a salt) to groups (with the bits of their salts), a hot key spread over its salts."""
    return rows.join(per_salt(groups, salt=salt), [*keys, salt], how)


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], most: int = 20000, salt: str = "salt") -> DataFrame:
    """Joins rows (with a salt) to a stored row a group: sent to every task where groups are few, counted; else by all salts of a key."""
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), keys)
    return rows.join(per_salt(groups.withColumn("salts", F.lit(-1).cast("long")), salt=salt), [*keys, salt])

"""Numbers, times and paths in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_column(names: list[str], aliases: tuple[str, ...]) -> str | None:
    """The first alias that a header has, whatever its case."""
    lower = {n.strip().lower(): n for n in names}
    return next((lower[a] for a in aliases if a in lower), None)


def parse_loose_time(s: Column) -> Column:
    """Unix seconds of a number (milliseconds if huge), an ISO or an EXIF date; null of anything else."""
    t = F.trim(s)
    number = F.when(t.rlike(r"^[0-9]{1,18}(?:\.[0-9]+)?$"), t.cast("double"))
    iso = F.regexp_replace(F.regexp_replace(t, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3"), "[TZ]", " ")
    date = F.unix_micros(F.try_to_timestamp(F.trim(iso))) / 1e6
    return F.when(number > 1e11, number / 1000).when(number > 1e9, number).when(number.isNull(), date)


def time_from_name(name: Column) -> Column:
    """Unix seconds of the first 14 digits of a file's name."""
    digits = F.regexp_extract(F.regexp_replace(name, "[^0-9]", ""), r"^(\d{14})", 1)
    return F.unix_micros(F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))) / 1e6


def number_after(text: Column, keys: tuple[str, ...]) -> Column:
    """The first number after any of the keys, whatever their case."""
    found = F.regexp_extract(text, rf"(?i)(?:{'|'.join(keys)})\s*[:=]?\s*([-+]?[0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(found != "", found.cast("double"))


def tag_body(text: Column, tag: str) -> Column:
    found = F.regexp_extract(text, rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", 1)
    return F.when(found != "", F.trim(found))


def json_or(doc: Column, path: str, default: float) -> Column:
    return F.coalesce(F.get_json_object(doc, path).cast("double"), F.lit(default))

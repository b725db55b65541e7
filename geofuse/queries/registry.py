"""Where queries and their SQL twins are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, q: str | None = None) -> Callable[[Query], Query]:
    """Enters a query; q is its DuckDB SQL over the named views."""

    def enter(f: Query) -> Query:
        QUERIES[name] = f
        if q:
            ORACLES[name] = oracle(*views, q=q)
        return f

    return enter


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, and never minus zero: sums in another order must not show."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)

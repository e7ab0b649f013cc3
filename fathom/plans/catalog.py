"""Registry of check queries: one Spark plan and (where SQL can say it) one

Every query reads the driver's tables through the views in
:mod:`fathom.plans.views`, over the whole table.  Computed DOUBLE columns are
rounded to 6 decimals on both sides so the value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.plans.views import view, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql, *views) if views else sql.strip()
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column to 6 decimals (presentation for the check).

    ``round(x * 1e6) / 1e6`` rounds the binary value the way DuckDB's
    ``round(x, 6)`` does; Spark's ``round(x, 6)`` rounds the decimal string
    half-up and differs on values like 0.7340525.
    """
    return df.select(*[
        (F.round(F.col(f.name) * F.lit(1e6)) / F.lit(1e6)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


# Import the query modules so their @register calls run.
from fathom.plans import (  # noqa: E402,F401
    q_qc,
    q_grid,
    q_geo,
    q_products,
    q_stream,
    q_convert,
    q_more,
)

"""Joins that keep NULL keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialize_small

#: A table of one row a survey is broadcast only up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 250_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` where a NULL key equals a NULL key, as a
    NULL group of ``groupBy`` does.  Keys come from ``left``."""
    names = {k: f"_ns_{k}" for k in keys}
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), cond, how).drop(*names.values())


def join_surveys(rows: DataFrame, surveys: DataFrame) -> DataFrame:
    """``rows`` with the columns of their survey (one row a survey), a NULL
    survey too.  The surveys are materialised and counted, so that they are
    broadcast when few: a shuffle on the survey would leave the rows of a
    survey, however many, to one task."""
    surveys = materialize_small(surveys)
    few = surveys.count() <= BROADCAST_ROWS
    return join_null_safe(rows, F.broadcast(surveys) if few else surveys, ["survey_id"])

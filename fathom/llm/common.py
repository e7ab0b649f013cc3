"""Helpers shared by the training-data operators.

Internal columns get names that the caller's table does not use (``fresh``),
so extra columns with clashing names pass through untouched.  Intermediate
tables are written under the shared checkpoint folder of the session
(``stored``): a lost executor re-reads them instead of recomputing, and every
consumer sees the same rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.session import checkpoint_dir, ship_package

#: Words are maximal runs of anything but these ASCII white-space characters.
WS = r"[\x20\x09-\x0D]+"
#: A table of keys is broadcast only up to this many rows (about 30 MB); beyond it the join shuffles.
BROADCAST_ROWS = 250_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Python tasks import this package by name."""
    ship_package(spark)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of the session take at most ``most`` bytes, so that what a
    task holds does not grow with the texts; a lower limit stays as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([a-z]?)b?", spark.conf.get(key).lower()).groups()
    now = int(number) << 10 * "kmgtp".index(unit) + 10 if unit and unit in "kmgtp" else int(number)
    if not 0 < now <= most:
        spark.conf.set(key, f"{most}b")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not use, in any letter case."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as the build side of a join: broadcast when its counted size is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """32 bytes that stand for a text when rows are told apart; null and empty differ."""
    return F.unhex(F.sha2(F.col(column).cast("binary"), 256))


def training_fold(id_column: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == fold


def apply_marks(docs: DataFrame, keys: Mapping[str, Column], decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (the key columns and ``kept``, one
    row per document) keeps.

    Rows alike in every key are one document written several times: one of
    them stays when any of their decisions is to keep.  Only keys that lose a
    row travel; they are broadcast when few, else the join shuffles.
    """
    names = list(keys)
    marks = stored(decisions.groupBy(*names)
                   .agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("rows"))
                   .where(~F.col("any_kept") | (F.col("rows") > 1))
                   .select(*names, F.col("any_kept").alias("one")), "marks")
    count, again = marks.agg(F.count(F.lit(1)), F.count_if("one")).first()
    inner = dict(zip(names, fresh(docs, *[f"key_{n}" for n in names]), strict=True))
    one, = fresh(docs, "one_of_many")
    right = marks.select(*[F.col(n).alias(f"mark_{n}") for n in names], F.col("one").alias(one))
    right_names, left = fresh(docs, *[f"mark_{n}" for n in names]), docs.withColumns({inner[n]: keys[n] for n in names})
    right = right.toDF(*right_names, one)
    on = None
    for n, r in zip(names, right_names, strict=True):
        same = left[inner[n]].eqNullSafe(right[r])
        on = same if on is None else on & same
    found = left.join(small_side(right, count), on, "left").drop(*right_names)
    out = found.where(F.col(one).isNull())
    if again:
        out = out.unionByName(found.where(F.col(one)).dropDuplicates(list(inner.values())))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

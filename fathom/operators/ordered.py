"""Skew-safe ordered position and previous-row values.

Several reference computations are order dependent inside a group: the
detector's depth jumps (previous depth in time order), the position of a
sounding after sorting, the in-cell rank of the running grid average.  The
textbook form ``row_number().over(Window.partitionBy(group).orderBy(...))``
puts a whole group into one task, and one survey or one grid cell may hold a
third of all rows.

``sequence`` computes the same values without that bottleneck:

1. range-partition the rows on ``group + order`` (Spark samples the key
   distribution, so a hot group is cut into many balanced slices);
2. rank / lag inside each (slice, group) with an ordinary window — every
   window partition is bounded by the slice size;
3. stitch the slices together with a per-(slice, group) summary table
   (row count, last values) whose size is bounded by slices + groups, never
   by rows: a running sum of counts gives each slice's offset and a ``lag``
   over the summary gives the value that precedes a slice's first row.

The summary joins back on (slice, group); AQE broadcasts it when its runtime
size is small and otherwise keeps a sort-merge join, so nothing unbounded is
ever broadcast.

Range boundaries come from sampling, so two separately planned exchanges may
slice differently.  The sliced and ranked rows are therefore cut from their
lineage with ``checkpoint()`` (into ``spark.checkpoint.dir``) before the
summary and the join read them: both see the same slices, and a lost executor
re-reads the checkpoint instead of re-sampling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import checkpoint_dir

_PART = "_seq_part"


def _key(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.asc_nulls_first()


def _and_all(left: DataFrame, right: DataFrame, ren: dict) -> Column:
    cond = F.lit(True)
    for c, r in ren.items():
        cond = cond & left[c].eqNullSafe(F.col(r))
    return cond


def sequence(df: DataFrame, by: Sequence[str], order: Sequence[str],
             lags: Sequence[str] = (), pos_col: str = "pos",
             count_col: str | None = None, rank_from_end_col: str | None = None,
             last_null_of: str | None = None, num_slices: int | None = None) -> DataFrame:
    """Add ``pos_col`` (0-based position inside ``by`` following ``order``),
    ``prev_<c>`` for every column in ``lags`` (NULL on a group's first row),
    and optionally the group size / 1-based rank counted from the end and
    ``last_null_pos`` -- the position of the group's last row whose
    ``last_null_of`` column is NULL (-1 if none), taken from the summary.

    ``order`` should make rows unique inside a group (end it with a unique
    id); remaining ties are broken arbitrarily but consistently.
    """
    by, order = list(by), list(order)
    spark = df.sparkSession
    # Slices default to the shuffle parallelism; large clusters can raise
    # ``fathom.sequence.slices`` so each slice stays a few hundred MB.
    n = num_slices or int(spark.conf.get("fathom.sequence.slices",
                                         spark.conf.get("spark.sql.shuffle.partitions")))
    keys = by + order

    sliced = (df.repartitionByRange(n, *[_key(k) for k in keys])
                .withColumn(_PART, F.spark_partition_id()))
    w = Window.partitionBy(_PART, *by).orderBy(*[_key(k) for k in order])
    local = sliced.withColumn("_seq_lpos", F.row_number().over(w) - 1)
    for c in lags:
        local = local.withColumn(f"_seq_lprev_{c}", F.lag(c).over(w))
    checkpoint_dir(spark)
    local = local.checkpoint(eager=True)

    # One row per (slice, group): bounded by slices + groups.
    last_of = F.struct(*[F.col(k) for k in order])
    extra = ([F.max(F.when(F.col(last_null_of).isNull(), F.col("_seq_lpos"))).alias("_seq_lnull")]
             if last_null_of else [])
    summary = local.groupBy(_PART, *by).agg(
        F.count(F.lit(1)).alias("_seq_cnt"),
        *[F.max_by(F.col(c), last_of).alias(f"_seq_last_{c}") for c in lags], *extra)
    sw = Window.partitionBy(*by).orderBy(_PART)
    summary = summary.withColumn(
        "_seq_off",
        F.coalesce(F.sum("_seq_cnt").over(sw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for c in lags:
        summary = summary.withColumn(f"_seq_carry_{c}", F.lag(f"_seq_last_{c}").over(sw))
    if count_col or rank_from_end_col:
        summary = summary.withColumn("_seq_n", F.sum("_seq_cnt").over(Window.partitionBy(*by)))
    if last_null_of:
        summary = summary.withColumn("last_null_pos", F.coalesce(
            F.max(F.col("_seq_off") + F.col("_seq_lnull")).over(Window.partitionBy(*by)), F.lit(-1)))
    summary = summary.drop("_seq_cnt", "_seq_lnull", *[f"_seq_last_{c}" for c in lags])

    # Null-safe on the group keys: a NULL group is a group, never dropped.
    ren = {c: f"_seq_g_{i}" for i, c in enumerate(by)}
    summary = summary.withColumnsRenamed(ren) if ren else summary
    out = local.join(summary.withColumnRenamed(_PART, "_seq_part_s"),
                     (local[_PART] == F.col("_seq_part_s")) & _and_all(local, summary, ren),
                     how="inner").drop("_seq_part_s", *ren.values())
    out = out.withColumn(pos_col, F.col("_seq_off") + F.col("_seq_lpos"))
    for c in lags:
        out = out.withColumn(
            f"prev_{c}",
            F.when(F.col("_seq_lpos") == 0, F.col(f"_seq_carry_{c}")).otherwise(F.col(f"_seq_lprev_{c}")))
    if count_col:
        out = out.withColumn(count_col, F.col("_seq_n"))
    if rank_from_end_col:
        out = out.withColumn(rank_from_end_col, F.col("_seq_n") - F.col(pos_col))
    drop = [_PART, "_seq_lpos", "_seq_off", "_seq_n"]
    drop += [f"_seq_lprev_{c}" for c in lags] + [f"_seq_carry_{c}" for c in lags]
    return out.drop(*drop)

"""The skew-safe ordered position / lag equals a plain window, also when one
group holds most of the rows and spans many range slices, and for a NULL group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators.ordered import sequence


def test_sequence_matches_window_under_skew(spark):
    n = 20000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 7, F.lit(0)).when(F.col("id") % 10 == 7, F.lit(None))
         .otherwise(F.col("id") % 5).alias("g"),
        F.col("id").alias("idx"),
        ((F.col("id") * 7919) % 1000).alias("t"),
        F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("id") * 1.5).alias("v"))
    s = sequence(df, ["g"], ["t", "idx"], lags=["v"], count_col="n", rank_from_end_col="r",
                 last_null_of="v", num_slices=16)
    w = Window.partitionBy("g").orderBy("t", "idx")
    ref = df.select("g", "idx", (F.row_number().over(w) - 1).alias("p"), F.lag("v").over(w).alias("pv"),
                    F.count(F.lit(1)).over(Window.partitionBy("g")).alias("nn"))
    ref = ref.join(df.select("idx", "v"), "idx")
    ln = ref.groupBy("g").agg(F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("p"))), F.lit(-1)).alias("ln"))
    r2 = ref.drop("v").withColumnRenamed("g", "g2").withColumnRenamed("idx", "idx2")
    j = s.join(r2, s["g"].eqNullSafe(r2["g2"]) & (s["idx"] == r2["idx2"]))
    ln2 = ln.withColumnRenamed("g", "g3")
    j = j.join(ln2, j["g"].eqNullSafe(ln2["g3"]))
    bad = j.where((F.col("pos") != F.col("p")) | ~F.col("prev_v").eqNullSafe(F.col("pv"))
                  | (F.col("n") != F.col("nn")) | (F.col("r") != F.col("nn") - F.col("p"))
                  | (F.col("last_null_pos") != F.col("ln")))
    assert j.count() == n and bad.count() == 0

"""Check queries for the streaming operators (§2.13).

Spark writes a view's rows into a landing folder in time-ordered slices
(one append per slice); after each slice the streaming query runs with
``trigger(availableNow=True)`` from the same checkpoint, so state crosses
micro-batches and query restarts.  The final sink is read back in batch, so
the result can be compared with the batch oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fathom.operators import rules as rl
from fathom.plans.catalog import r6, register
from fathom.plans.oracle import sql_duplicate_ts, sql_range
from fathom.plans.views import view
from fathom.session import scratch_table_path
from fathom.streaming import survey_stream as ss

SLICES = 4


def _landing(spark, sf_dir, vname, cols):
    src = view(spark, sf_dir, vname).select(*cols)
    # Slice boundaries: SLICES-1 approximate quantiles of event time (a bounded list).
    micros = F.unix_micros(F.col("timestamp").cast("timestamp")).cast("double")
    qs = src.select(micros.alias("t")).approxQuantile("t", [i / SLICES for i in range(1, SLICES)], 0.001)
    edges = [float("-inf")] + qs + [float("inf")]
    base = scratch_table_path(spark, f"stream-{uuid.uuid4().hex}")
    slices = [src.where((micros >= lo) & (micros < hi)) for lo, hi in zip(edges[:-1], edges[1:])]
    slices[0] = slices[0].unionByName(src.where(micros.isNull()))
    return base, src.schema, slices


def _run_slices(spark, base, slices, start_query):
    """Append each slice, then drain it with an availableNow run.

    Stateful streams fix their state partitions from
    ``spark.sql.shuffle.partitions`` at the first start (kept in the
    checkpoint); it is one a task slot of the cluster while the query starts,
    and the session's own value is restored afterwards."""
    landing = f"{base}/landing"
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    for part in slices:
        part.write.mode("append").parquet(landing)
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
        try:
            q = start_query(landing)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", previous)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))


def _rules_query(spark, sf_dir):
    cols = ["survey_id", "idx", "timestamp", "latitude", "longitude", "depth", "beam_angle", "quality"]
    base, schema, slices = _landing(spark, sf_dir, "soundings_mbes", cols)
    out, ckpt = f"{base}/out", f"{base}/ckpt"

    def start(landing):
        s = ss.soundings_stream(spark, landing, schema)
        return (ss.stream_range_anomalies(s, "mbes").writeStream.format("parquet")
                  .option("checkpointLocation", ckpt).option("path", out)
                  .outputMode("append").trigger(availableNow=True).start())
    _run_slices(spark, base, slices, start)
    return spark.read.parquet(out)


register("stream_range_rules", sql_range("soundings_mbes", "mbes"), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(_rules_query(spark, sf_dir).select(
        "survey_id", "idx", "rule", "type", "severity", "column", "value", "threshold")))


@register("stream_ingest", "SELECT survey_id, idx, depth FROM soundings_nav", ("soundings_nav",))
def q_stream_ingest(spark, sf_dir):
    cols = ["survey_id", "idx", "timestamp", "latitude", "longitude", "depth"]
    base, schema, slices = _landing(spark, sf_dir, "soundings_nav", cols)
    out, ckpt = f"{base}/out", f"{base}/ckpt"

    def start(landing):
        s = ss.soundings_stream(spark, landing, schema, "sbes", max_files_per_trigger=4)
        return (s.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out)
                 .partitionBy("survey_id").trigger(availableNow=True).start())
    _run_slices(spark, base, slices, start)
    return spark.read.parquet(out).select(F.col("survey_id").cast("long").alias("survey_id"), "idx", "depth")


@register("stream_duplicates", sql_duplicate_ts("points_lidar"), ("points_lidar",))
def q_stream_dups(spark, sf_dir):
    cols = ["survey_id", "idx", "timestamp", "latitude", "longitude", "elevation"]
    base, schema, slices = _landing(spark, sf_dir, "points_lidar", cols)
    out, ckpt = f"{base}/out", f"{base}/ckpt"

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    def start(landing):
        s = ss.soundings_stream(spark, landing, schema, "lidar")
        return (ss.stream_timestamp_counts(s, "1 hour").writeStream.outputMode("update")
                  .foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    _run_slices(spark, base, slices, start)
    final = spark.read.parquet(out).groupBy("survey_id", "timestamp").agg(F.max("n").alias("n"))
    d = final.where(F.col("n") > 1).groupBy("survey_id").agg(F.sum("n").alias("duplicate_rows"))
    return r6(d.select(*rl._anomaly(
        F.col("survey_id"), F.lit(None), "duplicate_timestamp_check", "duplicate_timestamp", "medium", "timestamp",
        F.col("duplicate_rows"), F.lit("0"), F.lit(""))).select(
        "survey_id", "idx", "rule", "type", "severity", "column", "value", "threshold"))


@register("stream_coordinate_duplicates", """
SELECT survey_id, latitude, longitude, count(*) AS n FROM soundings_nav
WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY survey_id, latitude, longitude HAVING count(*) > 10""", ("soundings_nav",))
def q_stream_coordinates(spark, sf_dir):
    """Coordinates over the detector's threshold after the last file; equal to the batch rule's groups."""
    cols = ["survey_id", "idx", "timestamp", "latitude", "longitude", "depth"]
    base, schema, slices = _landing(spark, sf_dir, "soundings_nav", cols)
    out, ckpt = f"{base}/out", f"{base}/ckpt"

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def start(landing):
        s = ss.soundings_stream(spark, landing, schema, "sbes")
        return (ss.stream_coordinate_duplicates(s, keep_days=36500.0).writeStream.outputMode("update")
                  .foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    _run_slices(spark, base, slices, start)
    return (spark.read.parquet(out).groupBy("survey_id", "latitude", "longitude").agg(F.max("n").alias("n"))
            .withColumn("survey_id", F.col("survey_id").cast("long")))


@register("stream_depth_jump", """
SELECT survey_id, idx, pos, CASE WHEN abs(diff) > 200 THEN 'high' ELSE 'medium' END AS severity,
       round(diff, 6) AS value, round(least(1.0, abs(diff) / 200.0), 6) AS confidence
FROM (SELECT survey_id, idx, depth - lag(depth) OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) AS diff,
             row_number() OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) - 1 AS pos
      FROM soundings_mbes) s
WHERE diff > 100 OR diff < -100""", ("soundings_mbes",))
def q_stream_jump(spark, sf_dir):
    cols = ["survey_id", "idx", "timestamp", "depth"]
    base, schema, slices = _landing(spark, sf_dir, "soundings_mbes", cols)
    out, ckpt = f"{base}/out", f"{base}/ckpt"

    def start(landing):
        s = ss.soundings_stream(spark, landing, schema)
        return (ss.stream_depth_jumps(s).writeStream.format("parquet").option("checkpointLocation", ckpt)
                  .option("path", out).outputMode("append").trigger(availableNow=True).start())
    _run_slices(spark, base, slices, start)
    r = spark.read.parquet(out).where(F.col("kind") == "jump")
    return r6(r.select("survey_id", "idx", "pos", "severity", "value", "confidence"))


@register("stream_convert", """
SELECT survey_id, type, count(*) AS n FROM (""" + sql_range("soundings_mbes", "mbes") + """) a
GROUP BY survey_id, type""", ("soundings_mbes",))
def q_stream_convert(spark, sf_dir):
    cols = ["survey_id", "idx", "timestamp", "latitude", "longitude", "depth", "beam_angle", "quality"]
    base, schema, slices = _landing(spark, sf_dir, "soundings_mbes", cols)
    out, ckpt = f"{base}/out", f"{base}/ckpt"
    body = ss.convert_each_batch(lambda b: rl.range_anomalies(b, "mbes"), out)

    def start(landing):
        s = ss.soundings_stream(spark, landing, schema)
        return (s.writeStream.foreachBatch(body).option("checkpointLocation", ckpt)
                 .trigger(availableNow=True).start())
    _run_slices(spark, base, slices, start)
    return (spark.read.parquet(out).groupBy("survey_id", "type")
                 .agg(F.count(F.lit(1)).alias("n")))

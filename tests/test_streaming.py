"""Streaming operators equal their batch counterparts after replaying files
in time order with availableNow restarts from one checkpoint."""

import os
import tempfile

from pyspark.sql import functions as F

from fathom.operators import detector as det
from fathom.streaming import survey_stream as ss


def test_stateful_depth_jump_matches_batch(spark):
    rows = [(s, i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", 10.0 + (150.0 if i % 17 == 0 else 0.0) + i * 0.1)
            for s in (1, 2) for i in range(240)]
    df = spark.createDataFrame(rows, "survey_id long, idx long, timestamp string, depth double") \
              .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    base = tempfile.mkdtemp(prefix="fathom-stream-")
    landing, out, ckpt = os.path.join(base, "in"), os.path.join(base, "out"), os.path.join(base, "ckpt")
    for lo in range(0, 240, 60):
        df.where((F.col("idx") >= lo) & (F.col("idx") < lo + 60)).write.mode("append").parquet(landing)
        s = ss.soundings_stream(spark, landing, df.schema)
        q = (ss.stream_depth_jumps(s).writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted((r.survey_id, r.idx, r.pos, round(r.value, 6)) for r in
                 spark.read.parquet(out).where("kind = 'jump'").collect())
    ref = sorted((r.survey_id, r.idx, r.pos, round(r.value, 6)) for r in
                 det.jump_anomalies(det.depth_sequence(df)).collect())
    assert got == ref and len(ref) > 0


def test_late_rows_are_dropped_and_counted(spark):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", 10.0 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "survey_id long, idx long, timestamp string, depth double") \
              .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    base = tempfile.mkdtemp(prefix="fathom-stream-late-")
    landing, out, ckpt = os.path.join(base, "in"), os.path.join(base, "out"), os.path.join(base, "ckpt")
    # The newer half arrives first; the older half is late relative to the kept state.
    for part in (df.where("idx >= 20"), df.where("idx < 20")):
        part.write.mode("append").parquet(landing)
        q = (ss.stream_depth_jumps(ss.soundings_stream(spark, landing, df.schema)).writeStream
               .format("parquet").option("path", out).option("checkpointLocation", ckpt)
               .trigger(availableNow=True).start())
        q.awaitTermination()
    late = spark.read.parquet(out).where("kind = 'late'").collect()
    assert [(r.survey_id, r.value) for r in late] == [(1, 20.0)]


def test_watermark_drops_late_duplicates(spark):
    """Counts per (survey, timestamp) in update mode; rows older than the
    watermark (max event time - delay) are dropped, not counted."""
    rows = [(1, i, f"2024-01-01 {h:02d}:00:00", 1.0) for i, h in enumerate([5, 5, 6, 9])]
    late = [(1, 10, "2024-01-01 05:00:00", 1.0)]  # arrives after 09:00 was seen
    schema = "survey_id long, idx long, timestamp string, depth double"
    to_ts = lambda d: d.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    base = tempfile.mkdtemp(prefix="fathom-stream-wm-")
    landing, out, ckpt = os.path.join(base, "in"), os.path.join(base, "out"), os.path.join(base, "ckpt")

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    for part in (rows, late):
        to_ts(spark.createDataFrame(part, schema)).write.mode("append").parquet(landing)
        s = ss.soundings_stream(spark, landing, to_ts(spark.createDataFrame(rows, schema)).schema)
        q = (ss.stream_timestamp_counts(s, "1 hour").writeStream.outputMode("update").foreachBatch(sink)
               .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    final = {str(r.timestamp): r.n for r in
             spark.read.parquet(out).groupBy("timestamp").agg(F.max("n").alias("n")).collect()}
    assert final["2024-01-01 05:00:00"] == 2  # the late copy was dropped


def test_duplicate_coordinates_cross_the_threshold(spark):
    """Told above ten soundings, over several files, for a NULL survey too; an idle coordinate's count is forgotten."""
    def rows(n, day, lat=1.0):
        return [(s, i, f"2024-01-{day:02d} 00:00:00", lat, 2.0) for s in ("a", None) for i in range(n)]
    schema = "survey_id string, idx long, timestamp string, latitude double, longitude double"
    base = tempfile.mkdtemp(prefix="fathom-stream-coord-")
    landing, out, ckpt = os.path.join(base, "in"), os.path.join(base, "out"), os.path.join(base, "ckpt")

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    # The third file's other coordinate moves the watermark past the first one's ten days.
    for part in (rows(8, 1), rows(4, 2), rows(1, 25, 9.0), rows(1, 26, 9.0), rows(5, 27)):
        df = spark.createDataFrame(part, schema).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        df.write.mode("append").parquet(landing)
        s = ss.soundings_stream(spark, landing, df.schema)
        q = (ss.stream_coordinate_duplicates(s, keep_days=10.0).writeStream.outputMode("update").foreachBatch(sink)
               .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted(((r.survey_id or "", r.latitude, r.n) for r in spark.read.parquet(out).collect()))
    assert got == [("", 1.0, 12), ("a", 1.0, 12)]


def test_depth_jumps_keep_any_survey_id(spark):
    """Survey ids that are file names, and NULL."""
    rows = [(s, i, f"2024-01-01 00:00:{i:02d}", 10.0 + 150.0 * (i % 5 == 4)) for s in ("a.csv", None) for i in range(20)]
    df = spark.createDataFrame(rows, "survey_id string, idx long, timestamp string, depth double") \
              .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    base = tempfile.mkdtemp(prefix="fathom-stream-id-")
    landing, out, ckpt = os.path.join(base, "in"), os.path.join(base, "out"), os.path.join(base, "ckpt")
    for part in ("idx < 9", "idx >= 9"):
        df.where(part).write.mode("append").parquet(landing)
        q = (ss.stream_depth_jumps(ss.soundings_stream(spark, landing, df.schema)).writeStream.format("parquet")
               .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted((r.survey_id or "", r.idx, r.value) for r in spark.read.parquet(out).collect())
    want = sorted((r.survey_id or "", r.idx, r.value) for r in det.jump_anomalies(det.depth_sequence(df)).collect())
    assert got == want and len(got) == 14


def test_duplicate_coordinates_share_calls(spark):
    """Coordinates of a bucket are counted in one call, each on its own: far fewer state rows than
    coordinates, the batch counts (a sounding without a time too), and an idle one of a busy bucket is forgotten."""
    days = [(1, 12), (2, 12), (25, 1), (26, 1), (27, 5)]
    base = tempfile.mkdtemp(prefix="fathom-stream-bucket-")
    landing, out, ckpt = os.path.join(base, "in"), os.path.join(base, "out"), os.path.join(base, "ckpt")
    schema = "survey_id long, idx long, timestamp timestamp, latitude double, longitude double"
    rows_of_state = []

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    for day, n in days:
        # A third of the coordinates has no sounding in the later files; one more row has no time.
        df = (spark.range(600 * n).select(F.lit(None if day == 2 else 3).cast("long").alias("survey_id"), F.col("id").alias("idx"),
                                          F.make_timestamp(F.lit(2024), F.lit(1), F.lit(day), F.lit(0), F.lit(0), F.lit(0)).alias("timestamp"),
                                          (F.col("id") % 600).cast("double").alias("latitude"), F.lit(2.0).alias("longitude"))
              .where(F.lit(day < 25) | (F.col("latitude") >= 200)))
        if day == 1:
            df = df.unionByName(df.where("idx = 0").withColumn("timestamp", F.lit(None).cast("timestamp")))
        df.write.mode("append").parquet(landing)
        s = ss.soundings_stream(spark, landing, spark.createDataFrame([], schema).schema)
        q = (ss.stream_coordinate_duplicates(s, keep_days=10.0, buckets=8).writeStream.outputMode("update").foreachBatch(sink)
               .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        rows_of_state.append(max(p.stateOperators[0].numRowsTotal for p in q.recentProgress))
    assert max(rows_of_state) <= 2 * 8
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault((r.survey_id, r.latitude), []).append(r.n)
    assert set(got) == {(s, float(k)) for s in (None, 3) for k in range(600)}
    assert got[(3, 0.0)] == [13] and got[(3, 1.0)] == [12] and got[(None, 5.0)] == [12]
    # The others go on: the watermark never passes ten days after their last sounding within a run's rows.
    assert all(sorted(got[(3, float(k))]) == [12, 13, 14, 19] for k in range(200, 600))

"""Structured Streaming over arriving survey files.

* ``soundings_stream``: ``readStream`` over a folder of survey files
  (Parquet or CSV with a declared schema), standardised like the batch scan.
* range rules: the batch projection, unchanged, on the streaming DataFrame.
* duplicate timestamps: event time cast to TIMESTAMP, ``withWatermark`` and
  a ``groupBy(survey, timestamp).count()`` in update mode; rows later than
  the watermark are dropped by Spark.
* duplicate coordinates: ``applyInPandasWithState`` keeps one count a
  coordinate, told once it is over the detector's threshold; event-time timers
  drop coordinates that nothing came to for long.  The coordinates of a survey
  are dealt into buckets by their hash: a call and a state row serve a bucket,
  not a single coordinate, so calls do not grow with the coordinates.
* depth jumps: ``applyInPandasWithState`` keyed by survey keeps the last
  (timestamp, idx, depth, position) across micro-batches; a micro-batch's
  rows of one survey are sorted and diffed in Arrow batches; rows older than
  the kept state are late, dropped and counted.
* ``convert_each_batch``: ``foreachBatch`` runs a batch plan per micro-batch
  and overwrites only that batch's output partition (idempotent on replay).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathom.operators import rules as rl
from fathom.operators.detector import DUPLICATE_COORD_MIN, HIGH_JUMP, MAX_DEPTH_JUMP
from fathom.sources.files import standardize

#: Buckets that a survey's coordinates are dealt into.
COORDINATE_BUCKETS = 128
JUMP_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("idx", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("value", T.DoubleType()), T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType())])
JUMP_STATE = T.StructType([
    T.StructField("ts", T.LongType()), T.StructField("idx", T.LongType()),
    T.StructField("depth", T.DoubleType()), T.StructField("pos", T.LongType()),
    T.StructField("has_depth", T.BooleanType())])


def soundings_stream(spark: SparkSession, path: str, schema: T.StructType | str, sensor: str = "mbes",
                     fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of soundings from files arriving in ``path``."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.parquet(path) if fmt == "parquet" else r.option("header", True).csv(path)
    s = standardize(raw, sensor)
    # Watermarks need TIMESTAMP (Parquet timestamps without zone arrive as TIMESTAMP_NTZ).
    return s.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def stream_range_anomalies(stream: DataFrame, sensor: str) -> DataFrame:
    return rl.range_anomalies(stream, sensor)


def stream_timestamp_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running count per (survey, timestamp); update mode emits changed keys."""
    return (stream.withWatermark("timestamp", delay)
                  .groupBy("survey_id", "timestamp").agg(F.count(F.lit(1)).alias("n")))


def _counts_from(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_pandas()


def _counts_to(counts: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(counts, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def stream_coordinate_duplicates(stream: DataFrame, most: int = DUPLICATE_COORD_MIN, delay: str = "1 day", keep_days: float = 365.0,
                                 buckets: int = COORDINATE_BUCKETS) -> DataFrame:
    """Coordinates of a survey that more than ``most`` soundings share, as they
    arrive: (survey_id, latitude, longitude, n), again at each further arrival
    (the last n counts).  The state of a coordinate is its count; it goes when
    the watermark is ``keep_days`` past its last sounding.  Soundings without a
    position have no coordinate; a NULL survey is a survey.

    A survey's coordinates are in ``buckets`` buckets; the state of one is the
    table of its coordinates' counts, which a micro-batch updates as a whole."""
    from fathom.session import ship_package
    ship_package(stream.sparkSession)
    fields = [stream.schema[c] for c in ("survey_id", "latitude", "longitude")]
    schema = T.StructType([*fields, T.StructField("n", T.LongType())])
    state_type = T.StructType([T.StructField("counts", T.BinaryType())])
    at, keep = ["latitude", "longitude"], int(keep_days * 86_400_000)

    def count(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        coords = [_counts_from(state.get[0])] if state.exists else []
        held = len(coords[0]) if coords else 0
        times = np.zeros(0, np.int64)
        if not state.hasTimedOut:
            rows = pd.concat([b[[*at, "timestamp"]] for b in batches], ignore_index=True)
            known = rows["timestamp"].notna().to_numpy()
            times = np.where(known, rows["timestamp"].to_numpy("datetime64[ms]").astype(np.int64), 0)
            coords.append(rows[at])
        # The first rows are the coordinates held, each once, so they have the first numbers.
        every = pd.concat([c[at] for c in coords], ignore_index=True)
        of = every.groupby(at, dropna=False, sort=False).ngroup().to_numpy()
        new = np.flatnonzero(np.r_[True, of[1:] > np.maximum.accumulate(of)[:-1]])
        n, last, until = (np.zeros(len(new), np.int64) for _ in range(3))
        if held:
            for to, c in ((n, "n"), (last, "last"), (until, "until")):
                to[:held] = coords[0][c]
        came = np.bincount(of[held:], minlength=len(new))
        n += came
        np.maximum.at(last, of[held:], times)
        until = np.where(came > 0, np.maximum(last + keep, watermark + 1), until)
        counts = every.iloc[new].assign(n=n, last=last, until=until)
        told = counts[(came > 0) & (n > most)]
        # As a timer of its own would: what nothing came to goes once the watermark has passed its time.
        counts = counts[until >= watermark]
        if len(counts):
            state.update((_counts_to(counts),))
            state.setTimeoutTimestamp(int(counts["until"].min()))
        else:
            state.remove()
        if len(told):
            yield pd.DataFrame({"survey_id": [key[0]] * len(told), **{c: told[c].to_numpy() for c in [*at, "n"]}})

    placed = stream.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).withWatermark("timestamp", delay)
    bucket = F.pmod(F.xxhash64(*at), F.lit(buckets)).alias("bucket")
    return (placed.select("survey_id", *at, "timestamp", bucket).groupBy("survey_id", "bucket")
            .applyInPandasWithState(count, schema, state_type, "update", GroupStateTimeout.EventTimeTimeout))


def _jump_fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    survey = None if pd.isna(key[0]) else key[0]
    pdf = pd.concat(list(batches), ignore_index=True)
    pdf["ts"] = pd.to_datetime(pdf["timestamp"]).astype("int64") // 1000
    pdf = pdf.sort_values(["ts", "idx"], kind="mergesort")
    if state.exists:
        last_ts, last_idx, last_depth, last_pos, has_depth = state.get
    else:
        last_ts, last_idx, last_depth, last_pos, has_depth = None, None, None, -1, False
    if last_ts is not None:
        late = (pdf["ts"] < last_ts) | ((pdf["ts"] == last_ts) & (pdf["idx"] <= last_idx))
    else:
        late = pd.Series(False, index=pdf.index)
    on_time = pdf[~late]
    out = []
    n_late = int(late.sum())
    if n_late:
        out.append(pd.DataFrame([{"survey_id": survey, "kind": "late", "idx": None, "pos": None,
                                  "value": float(n_late), "severity": None, "confidence": None}]))
    if len(on_time):
        depth = on_time["depth"].astype("float64").to_numpy()
        prev = pd.Series(depth).shift(1).to_numpy()
        prev[0] = last_depth if has_depth else float("nan")
        diff = depth - prev
        pos = last_pos + 1 + pd.RangeIndex(len(on_time)).to_numpy()
        idxs = on_time["idx"].to_numpy()
        hit = (diff > MAX_DEPTH_JUMP) | (diff < -MAX_DEPTH_JUMP)
        d = diff[hit]
        if len(d):
            out.append(pd.DataFrame({
                "survey_id": survey, "kind": "jump", "idx": idxs[hit].astype("int64"), "pos": pos[hit],
                "value": d, "severity": ["high" if abs(x) > HIGH_JUMP else "medium" for x in d],
                "confidence": [min(1.0, abs(x) / HIGH_JUMP) for x in d]}))
        tail = on_time.iloc[-1]
        last_d = depth[-1]
        state.update((int(tail["ts"]), int(tail["idx"]), None if last_d != last_d else float(last_d),
                      int(pos[-1]), last_d == last_d))
    cols = ["survey_id", *[f.name for f in JUMP_SCHEMA.fields]]
    yield pd.concat(out, ignore_index=True)[cols] if out else pd.DataFrame(columns=cols)


def stream_depth_jumps(stream: DataFrame) -> DataFrame:
    """Depth jumps across micro-batches (stateful per survey), plus 'late' rows.
    Survey ids keep their type; a NULL survey is a survey."""
    from fathom.session import ship_package
    ship_package(stream.sparkSession)
    s = stream.select("survey_id", F.col("idx").cast("long").alias("idx"),
                      "timestamp", F.col("depth").cast("double").alias("depth"))
    return s.groupBy("survey_id").applyInPandasWithState(
        _jump_fn, T.StructType([stream.schema["survey_id"], *JUMP_SCHEMA.fields]), JUMP_STATE, "append", GroupStateTimeout.NoTimeout)


def convert_each_batch(plan: Callable[[DataFrame], DataFrame], out_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: run ``plan`` on the micro-batch and overwrite its own
    ``batch_id`` partition, so a replayed batch rewrites the same output."""
    def run(batch: DataFrame, batch_id: int) -> None:
        res = plan(batch).withColumn("batch_id", F.lit(batch_id))
        (res.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(out_path))
    return run

"""The default anomaly detector: depth jumps, unrealistic depths, and
coordinates shared by more than ten soundings.

Order-dependent parts (previous depth in time order, the position after the
sort) come from :func:`fathom.operators.ordered.sequence`, which stays
balanced when one survey holds most of the rows.  The duplicate-coordinate
check is a plain hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.ordered import sequence
from fathom.operators.rules import _anomaly

# Fixed values (must equal the reference's detector).
MAX_DEPTH_JUMP = 100.0
HIGH_JUMP = 200.0
DEPTH_LO, DEPTH_HI = 0.0, 12000.0
DUPLICATE_COORD_MIN = 10  # strictly more than this many points
DUPLICATE_COORD_FULL_CONFIDENCE = 50.0

CAPABILITIES = ["depth_jump_detection", "unrealistic_depth_detection",
                "coordinate_duplicate_detection"]


def time_order(df: DataFrame) -> list[str]:
    """Sort by timestamp when present, else file order; ``idx`` breaks ties."""
    return ["timestamp", "idx"] if "timestamp" in df.columns else ["idx"]


def depth_sequence(df: DataFrame) -> DataFrame:
    """Soundings with ``pos`` (time-order position) and ``prev_depth``."""
    return sequence(df.select("survey_id", "idx", "depth", *(["timestamp"] if "timestamp" in df.columns else [])),
                    by=["survey_id"], order=time_order(df), lags=["depth"])


def jump_anomalies(seq: DataFrame) -> DataFrame:
    diff = F.col("depth") - F.col("prev_depth")
    return (seq.withColumn("diff", diff)
               .where((F.col("diff") > MAX_DEPTH_JUMP) | (F.col("diff") < -MAX_DEPTH_JUMP))
               .select(*_anomaly(
                   F.col("survey_id"), F.col("idx"), "depth_jump_detection", "depth_jump",
                   "", "depth", F.col("diff"), F.lit(str(MAX_DEPTH_JUMP)),
                   F.format_string("Depth jump of %.2fm detected", F.col("diff")),
                   confidence=F.least(F.lit(1.0), F.abs(F.col("diff")) / HIGH_JUMP),
                   pos=F.col("pos"), source="detector"))
               .withColumn("severity", F.when(F.abs(F.col("value")) > HIGH_JUMP, "high").otherwise("medium")))


def unrealistic_anomalies(seq: DataFrame) -> DataFrame:
    d = F.col("depth")
    return (seq.where((d < DEPTH_LO) | (d > DEPTH_HI))
               .select(*_anomaly(
                   F.col("survey_id"), F.col("idx"), "unrealistic_depth_detection", "unrealistic_depth",
                   "high", "depth", d, F.lit("0-12000m"),
                   F.format_string("Unrealistic depth value: %.2fm", d),
                   confidence=F.lit(1.0), pos=F.col("pos"), source="detector")))


def duplicate_coordinate_groups(df: DataFrame) -> DataFrame:
    """(survey, latitude, longitude) groups with more than ten soundings."""
    return (df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
              .groupBy("survey_id", "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > DUPLICATE_COORD_MIN))


def duplicate_coordinate_anomalies(df: DataFrame) -> DataFrame:
    g = duplicate_coordinate_groups(df)
    return g.select(*_anomaly(
        F.col("survey_id"), F.lit(None), "coordinate_duplicate_detection", "coordinate_duplicate", "medium",
        "latitude,longitude", F.col("n"), F.lit(str(DUPLICATE_COORD_MIN)),
        F.format_string("Duplicate coordinates: %d points at (%.6f, %.6f)",
                        F.col("n"), F.col("latitude"), F.col("longitude")),
        confidence=F.least(F.lit(1.0), F.col("n") / DUPLICATE_COORD_FULL_CONFIDENCE), source="detector"))


def detector_anomalies(df: DataFrame) -> DataFrame:
    """jump ∪ unrealistic ∪ duplicate-coordinate (UNION ALL).  No depth → none."""
    if "depth" not in df.columns:
        from fathom.operators.rules import empty_anomalies
        return empty_anomalies(df)
    seq = depth_sequence(df)
    out = jump_anomalies(seq).unionByName(unrealistic_anomalies(seq))
    if "latitude" in df.columns and "longitude" in df.columns:
        out = out.unionByName(duplicate_coordinate_anomalies(df))
    return out

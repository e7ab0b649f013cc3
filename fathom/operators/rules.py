"""Deterministic QC rules over soundings tables.

Every per-point range rule of a sensor is evaluated in ONE narrow projection
(no shuffle); only flagged rows build the anomaly array that is exploded.
The group rules (duplicate timestamps, 3-sigma depth outliers) are hash
aggregates with map-side combine, joined back through a per-survey table that
AQE broadcasts when small.

Anomaly rows share one schema (see ``ANOMALY_COLUMNS``); ``idx`` is NULL for
group anomalies (the reference's ``"multiple"``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.joins import join_null_safe

# Fixed values (must equal the reference's): valid range per column, anomaly
# type, severity, threshold text and the description text around the value.
#   column:          lo,    hi,    type,                   severity, threshold,      description prefix,             suffix
RANGE_RULES = {
    "latitude":       (-90,   90,    "coordinate_range",     "high",   "-90-90",       "Invalid latitude value: ",      ""),
    "longitude":      (-180,  180,   "coordinate_range",     "high",   "-180-180",     "Invalid longitude value: ",     ""),
    "depth":          (0,     12000, "depth_range",          "high",   "0-12000m",     "Invalid depth value: ",         "m"),
    "beam_angle":     (-90,   90,    "beam_angle_range",     "medium", "-90-90°",      "Invalid beam angle: ",          "°"),
    "quality":        (0,     100,   "quality_range",        "medium", "0-100",        "Invalid quality value: ",       ""),
    "heading":        (0,     360,   "navigation_range",     "medium", "0-360°",       "Invalid heading value: ",       "°"),
    "pitch":          (-90,   90,    "navigation_range",     "medium", "-90-90°",      "Invalid pitch value: ",         "°"),
    "roll":           (-90,   90,    "navigation_range",     "medium", "-90-90°",      "Invalid roll value: ",          "°"),
    "velocity":       (0,     50,    "velocity_range",       "medium", "0-50m/s",      "Invalid velocity value: ",      "m/s"),
    "elevation":      (-1000, 10000, "elevation_range",      "high",   "-1000-10000m", "Invalid elevation value: ",     "m"),
    "intensity":      (0,     255,   "intensity_range",      "low",    "0-255",        "Invalid intensity value: ",     ""),
    "classification": (0,     31,    "classification_range", "medium", "0-31",         "Invalid classification code: ", ""),
}

# Rules per sensor, in the reference's order.
SENSOR_RULES = {
    "mbes": ["latitude", "longitude", "depth", "beam_angle", "quality",
             "duplicate_timestamp", "depth_consistency"],
    "sbes": ["latitude", "longitude", "depth", "heading", "pitch", "roll", "velocity"],
    "lidar": ["latitude", "longitude", "elevation", "intensity", "classification"],
    "generic": ["latitude", "longitude", "depth", "elevation"],
}
SENSOR_RULES["singlebeam"] = SENSOR_RULES["sbes"]
SENSOR_RULES["auv"] = SENSOR_RULES["sbes"]

GROUP_RULE_COLUMN = {"duplicate_timestamp": "timestamp", "depth_consistency": "depth"}

ANOMALY_COLUMNS = ["survey_id", "idx", "pos", "source", "rule", "type", "severity", "column",
                   "value", "threshold", "description", "confidence"]

OUTLIER_SIGMAS = 3.0
OUTLIER_MIN_ROWS = 10
OUTLIER_MIN_VALUES = 5


def rules_for(sensor: str) -> list[str]:
    return SENSOR_RULES.get(sensor, SENSOR_RULES["generic"])


def rule_name(rule: str) -> str:
    return f"{rule}_check" if rule in GROUP_RULE_COLUMN else f"{rule}_range_check"


def rules_applied(df: DataFrame, sensor: str) -> list[str]:
    """Names of the rules that apply, given the columns present (plan time)."""
    return [rule_name(r) for r in rules_for(sensor)
            if GROUP_RULE_COLUMN.get(r, r) in df.columns]


def value_text(c: Column) -> Column:
    """Render a number for messages (shortest round-trip form)."""
    return c.cast("double").cast("string")


def _anomaly(survey: Column, idx: Column, rule: str, typ: str, severity: str, column: str,
             value: Column, threshold: Column, description: Column,
             confidence: Column | None = None, pos: Column | None = None,
             source: str = "rule") -> list[Column]:
    return [survey.alias("survey_id"), idx.cast("long").alias("idx"),
            (pos if pos is not None else F.lit(None)).cast("long").alias("pos"),
            F.lit(source).alias("source"), F.lit(rule).alias("rule"), F.lit(typ).alias("type"),
            F.lit(severity).alias("severity"), F.lit(column).alias("column"),
            value.cast("double").alias("value"), threshold.cast("string").alias("threshold"),
            description.alias("description"),
            (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence")]


def range_condition(column: str) -> Column:
    lo, hi = RANGE_RULES[column][:2]
    c = F.col(column)
    return (c < F.lit(lo)) | (c > F.lit(hi))


def range_anomalies(df: DataFrame, sensor: str, only: list[str] | None = None) -> DataFrame:
    """All per-point range anomalies of ``sensor`` in one projection + explode."""
    cols = [r for r in rules_for(sensor) if r in RANGE_RULES and r in df.columns
            and (only is None or r in only)]
    if not cols:
        return empty_anomalies(df)
    flagged = []
    for c in cols:
        lo, hi, typ, sev, thr, pre, suf = RANGE_RULES[c]
        flagged.append(F.when(range_condition(c), F.struct(
            F.lit(f"{c}_range_check").alias("rule"), F.lit(typ).alias("type"),
            F.lit(sev).alias("severity"), F.lit(c).alias("column"),
            F.col(c).cast("double").alias("value"), F.lit(thr).alias("threshold"),
            F.concat(F.lit(pre), value_text(F.col(c)), F.lit(suf)).alias("description"))))
    any_bad = reduce(lambda a, b: a | b, [range_condition(c) for c in cols])
    exploded = (df.where(any_bad)
                  .select("survey_id", "idx", F.explode(F.array_compact(F.array(*flagged))).alias("a")))
    a = lambda f: F.col(f"a.{f}")
    return exploded.select(
        F.col("survey_id"), F.col("idx").cast("long").alias("idx"), F.lit(None).cast("long").alias("pos"),
        F.lit("rule").alias("source"), a("rule").alias("rule"), a("type").alias("type"),
        a("severity").alias("severity"), a("column").alias("column"), a("value").alias("value"),
        a("threshold").alias("threshold"), a("description").alias("description"),
        F.lit(None).cast("double").alias("confidence"))


def empty_anomalies(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False)).select(*_anomaly(
        F.col("survey_id"), F.lit(None), "", "", "", "", F.lit(None), F.lit(None), F.lit(None).cast("string")))


def duplicate_timestamp_counts(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Per survey: number of rows whose ``column`` value occurs more than once
    (all copies counted, NULL equals NULL).  Hot keys only grow a counter."""
    per_key = df.groupBy("survey_id", column).agg(F.count(F.lit(1)).alias("n"))
    return (per_key.where(F.col("n") > 1)
                   .groupBy("survey_id").agg(F.sum("n").alias("duplicate_rows")))


def duplicate_timestamp_anomalies(df: DataFrame, column: str = "timestamp") -> DataFrame:
    d = duplicate_timestamp_counts(df, column)
    return d.select(*_anomaly(
        F.col("survey_id"), F.lit(None), "duplicate_timestamp_check", "duplicate_timestamp", "medium",
        column, F.col("duplicate_rows"), F.lit("0"),
        F.format_string("Found %d duplicate timestamps", F.col("duplicate_rows"))))


def depth_stats(df: DataFrame, column: str = "depth") -> DataFrame:
    """Per-survey inputs of the 3-sigma rule (one small row per survey)."""
    return df.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_values"),
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))


def depth_outlier_anomalies(df: DataFrame, column: str = "depth") -> DataFrame:
    """|x - mean| > 3 * sample std, for surveys with >= 10 rows and >= 5 values."""
    stats = depth_stats(df, column).where(
        (F.col("n_rows") >= OUTLIER_MIN_ROWS) & (F.col("n_values") >= OUTLIER_MIN_VALUES))
    j = join_null_safe(df.select("survey_id", "idx", column), stats, ["survey_id"])
    bad = j.where(F.abs(F.col(column) - F.col("mean")) > F.lit(OUTLIER_SIGMAS) * F.col("std"))
    return bad.select(*_anomaly(
        F.col("survey_id"), F.col("idx"), "depth_consistency_check", "depth_outlier", "medium", column,
        F.col(column), F.format_string("3σ from mean (%.2f±%.2f)", F.col("mean"), F.col("std")),
        F.concat(F.lit("Depth outlier: "), value_text(F.col(column)), F.lit("m"))))


def rule_anomalies(df: DataFrame, sensor: str) -> DataFrame:
    """Union (ALL) of every rule of ``sensor`` whose column is present."""
    parts = [range_anomalies(df, sensor)]
    rules = rules_for(sensor)
    if "duplicate_timestamp" in rules and "timestamp" in df.columns:
        parts.append(duplicate_timestamp_anomalies(df))
    if "depth_consistency" in rules and "depth" in df.columns:
        parts.append(depth_outlier_anomalies(df))
    return reduce(lambda a, b: a.unionByName(b), parts)



def duplicate_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: does its ``keys`` value occur more than once in the survey
    (pandas ``duplicated(keep=False)``)?  Counted by a hash aggregate and
    joined back, so a hot key is a counter, not a window partition."""
    counts = df.groupBy("survey_id", *keys).agg(F.count(F.lit(1)).alias("_dup_n"))
    return (join_null_safe(df.select("survey_id", "idx", *keys), counts, ["survey_id", *keys], "left")
              .select("survey_id", "idx", (F.col("_dup_n") > 1).alias("is_duplicate")))


# Fixed values (must equal the reference's published validation rules): per
# sensor the required / optional fields and the coordinate ranges it serves.
# They disagree with the QC rules in two places (AUV depth 0-6000; beam_angle
# required for mbes), which ``rule_catalog_check`` makes visible.
VALIDATION_RULES = {
    "mbes": {"required": ["timestamp", "latitude", "longitude", "depth", "beam_angle"],
             "optional": ["quality", "intensity", "backscatter"],
             "ranges": {"latitude": (-90, 90), "longitude": (-180, 180), "depth": (0, 12000)}},
    "sbes": {"required": ["timestamp", "latitude", "longitude", "depth"],
             "optional": ["quality", "frequency"],
             "ranges": {"latitude": (-90, 90), "longitude": (-180, 180), "depth": (0, 12000)}},
    "lidar": {"required": ["timestamp", "latitude", "longitude", "elevation"],
              "optional": ["intensity", "classification"],
              "ranges": {"latitude": (-90, 90), "longitude": (-180, 180), "elevation": (-1000, 10000)}},
    "singlebeam": {"required": ["timestamp", "latitude", "longitude", "depth"],
                   "optional": ["quality"],
                   "ranges": {"latitude": (-90, 90), "longitude": (-180, 180), "depth": (0, 12000)}},
    "auv": {"required": ["timestamp", "latitude", "longitude", "depth"],
            "optional": ["heading", "pitch", "roll", "velocity"],
            "ranges": {"latitude": (-90, 90), "longitude": (-180, 180), "depth": (0, 6000)}},
}


def rule_catalog(spark) -> DataFrame:
    """The validation-rule catalogue as a small literal table
    (sensor, column, lo, hi, required)."""
    rows = [(s, c, float(lo), float(hi), c in v["required"])
            for s, v in VALIDATION_RULES.items() for c, (lo, hi) in v["ranges"].items()]
    return spark.createDataFrame(rows, "sensor string, column string, lo double, hi double, required boolean")


def rule_catalog_check(df: DataFrame, sensor: str) -> DataFrame:
    """Values outside the catalogue's ranges: soundings unpivoted to
    (column, value) and joined to the catalogue on column with a range
    condition.  The catalogue is a fixed literal of a few rows, so it is
    broadcast (a proven size bound)."""
    cat = rule_catalog(df.sparkSession).where(F.col("sensor") == sensor)
    cols = [c for c in VALIDATION_RULES[sensor]["ranges"] if c in df.columns]
    long = df.select("survey_id", "idx", F.expr("stack({}, {}) AS (column, value)".format(
        len(cols), ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols))))
    j = long.join(F.broadcast(cat), "column")
    return j.where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).select(
        "survey_id", "idx", "column", "value", "lo", "hi")

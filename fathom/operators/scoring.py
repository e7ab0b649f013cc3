"""Quality scores and the per-survey QC summary.

Scores depend only on counts per survey, so the summary path never builds
anomaly rows: ``rule_counts`` / ``detector_counts`` aggregate the rule
conditions directly (map-side partial aggregation, one small row per
survey), and the tiers are column expressions over those rows.  Anomaly rows
(``rules.rule_anomalies`` / ``detector.detector_anomalies``) are built only
for reports; passing them in counts them instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators import detector as det
from fathom.operators import rules as rl
from fathom.operators.joins import join_null_safe

# Anomaly-rate tiers of the rule score and the detector confidence.
RULE_TIERS = [(0.01, 0.9), (0.05, 0.8), (0.1, 0.7), (0.2, 0.5)]
RULE_TIER_ZERO, RULE_TIER_REST = 1.0, 0.2
DETECTOR_TIERS = [(0.01, 0.9), (0.05, 0.8), (0.1, 0.7)]
DETECTOR_TIER_REST = 0.5
HIGH_SEVERITY_CAP = 0.6


def anomaly_rate(anomalies: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(anomalies.cast("double"), total.cast("double")), F.lit(0.0))


def rule_score(anomalies: Column, high: Column, total: Column) -> Column:
    rate = anomaly_rate(anomalies, total)
    s = F.when(rate == 0, F.lit(RULE_TIER_ZERO))
    for bound, score in RULE_TIERS:
        s = s.when(rate < bound, F.lit(score))
    s = s.otherwise(F.lit(RULE_TIER_REST))
    s = F.when(high > 0, F.least(s, F.lit(HIGH_SEVERITY_CAP))).otherwise(s)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(s, 3))


def detector_confidence(anomalies: Column, high: Column, total: Column) -> Column:
    rate = anomaly_rate(anomalies, total)
    s = None
    for bound, score in DETECTOR_TIERS:
        s = F.when(rate < bound, F.lit(score)) if s is None else s.when(rate < bound, F.lit(score))
    s = s.otherwise(F.lit(DETECTOR_TIER_REST))
    s = F.when(high > 0, F.least(s, F.lit(HIGH_SEVERITY_CAP))).otherwise(s)
    return F.when(total == 0, F.lit(0.0)).otherwise(s)


def overall_score(anomalies: Column, total: Column) -> Column:
    ratio = F.lit(1.0) - anomaly_rate(anomalies, total)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def point_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("survey_id").agg(F.count(F.lit(1)).alias("total_points"))


def _sum_cols(cols: list[str]):
    from functools import reduce
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols]) if cols else F.lit(0).cast("long")


def _unrealistic(df: DataFrame) -> Column:
    if "depth" not in df.columns:
        return F.lit(0).cast("long")
    return F.count_if((F.col("depth") < det.DEPTH_LO) | (F.col("depth") > det.DEPTH_HI))


def rule_counts(df: DataFrame, sensor: str, with_detector_base: bool = False) -> DataFrame:
    """Per survey: total points and rule-anomaly counts (all, high, by type)
    without materialising anomaly rows.

    One aggregate pass computes the point count, every range rule's count
    and the depth statistics; the duplicate-timestamp and 3-sigma rules add
    one aggregate each.  Scores only need these counts, so nothing is
    exploded or shuffled per anomaly.
    """
    rules = rl.rules_for(sensor)
    cols = [r for r in rules if r in rl.RANGE_RULES and r in df.columns]
    aggs = [F.count(F.lit(1)).alias("total_points")]
    aggs += [F.count_if(rl.range_condition(c)).alias(f"_r_{c}") for c in cols]
    if with_detector_base:  # the detector's per-survey counts ride on the same pass
        aggs.append(_unrealistic(df).alias("_unreal"))
    outl = "depth_consistency" in rules and "depth" in df.columns
    if outl:
        aggs += [F.count("depth").alias("_n_values"), F.avg("depth").alias("_mean"),
                 F.stddev_samp("depth").alias("_std")]
    t = df.groupBy("survey_id").agg(*aggs)
    if outl:
        # The per-survey row feeds both the result and the 3-sigma pass; it is
        # one small row per survey, so materialise it instead of scanning twice.
        from fathom.session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        t = t.checkpoint(eager=True)
    types: dict[str, list[str]] = {}
    high: list[str] = []
    for c in cols:
        types.setdefault(rl.RANGE_RULES[c][2], []).append(f"_r_{c}")
        if rl.RANGE_RULES[c][3] == "high":
            high.append(f"_r_{c}")
    if "duplicate_timestamp" in rules and "timestamp" in df.columns:
        d = rl.duplicate_timestamp_counts(df).select("survey_id", F.lit(1).cast("long").alias("_g_dup"))
        t = join_null_safe(t, d, ["survey_id"], "left").fillna(0, subset=["_g_dup"])
        types["duplicate_timestamp"] = ["_g_dup"]
    if outl:
        ok = t.where((F.col("total_points") >= rl.OUTLIER_MIN_ROWS) & (F.col("_n_values") >= rl.OUTLIER_MIN_VALUES))
        o = (join_null_safe(df.select("survey_id", "depth"), ok.select("survey_id", "_mean", "_std"), ["survey_id"])
               .groupBy("survey_id")
               .agg(F.count_if(F.abs(F.col("depth") - F.col("_mean")) > F.lit(rl.OUTLIER_SIGMAS) * F.col("_std"))
                    .alias("_g_outlier")))
        t = join_null_safe(t, o, ["survey_id"], "left").fillna(0, subset=["_g_outlier"])
        types["depth_outlier"] = ["_g_outlier"]
    all_cols = [c for v in types.values() for c in v]
    return t.select("survey_id", "total_points",
                    _sum_cols(all_cols).alias("anomaly_count"), _sum_cols(high).alias("high_count"),
                    *[_sum_cols(v).alias(f"n_{k}") for k, v in types.items()],
                    *(["_unreal"] if with_detector_base else []))


def _detector_parts(df: DataFrame, t: DataFrame) -> DataFrame:
    """Join the detector's jump and duplicate-coordinate counts onto ``t``
    (one row per survey holding ``_unreal``)."""
    diff = F.col("depth") - F.col("prev_depth")
    jumps = (det.depth_sequence(df).groupBy("survey_id").agg(
        F.count_if((diff > det.MAX_DEPTH_JUMP) | (diff < -det.MAX_DEPTH_JUMP)).alias("_jump"),
        F.count_if(F.abs(diff) > det.HIGH_JUMP).alias("_jump_high")))
    t = join_null_safe(t, jumps, ["survey_id"], "left")
    if "latitude" in df.columns and "longitude" in df.columns:
        g = det.duplicate_coordinate_groups(df).groupBy("survey_id").agg(F.count(F.lit(1)).alias("_coord"))
        t = join_null_safe(t, g, ["survey_id"], "left")
    else:
        t = t.withColumn("_coord", F.lit(0).cast("long"))
    t = t.fillna(0, subset=["_jump", "_jump_high", "_coord"])
    return t.withColumns({"det_anomalies": F.col("_jump") + F.col("_unreal") + F.col("_coord"),
                          "det_high": F.col("_jump_high") + F.col("_unreal")})


def detector_counts(df: DataFrame) -> DataFrame:
    """Per survey: detector anomaly counts (all, high) without anomaly rows."""
    base = df.groupBy("survey_id").agg(F.count(F.lit(1)).alias("total_points"),
                                       _unrealistic(df).alias("_unreal"))
    if "depth" not in df.columns:
        return base.select("survey_id", "total_points", F.lit(0).cast("long").alias("anomaly_count"),
                           F.lit(0).cast("long").alias("high_count"))
    t = _detector_parts(df, base)
    return t.select("survey_id", "total_points", F.col("det_anomalies").alias("anomaly_count"),
                    F.col("det_high").alias("high_count"))


def anomaly_counts(anomalies: DataFrame, prefix: str) -> DataFrame:
    return anomalies.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias(f"{prefix}_anomalies"),
        F.count_if(F.col("severity") == "high").alias(f"{prefix}_high"))


def _with_counts(points: DataFrame, anomalies: DataFrame, prefix: str) -> DataFrame:
    return (join_null_safe(points, anomaly_counts(anomalies, prefix), ["survey_id"], "left")
                  .fillna(0, subset=[f"{prefix}_anomalies", f"{prefix}_high"]))


def rule_qc(df: DataFrame, sensor: str, anomalies: DataFrame | None = None) -> DataFrame:
    """Per survey: total points, rule anomaly counts and the tiered score."""
    if anomalies is None:
        t = rule_counts(df, sensor).select("survey_id", "total_points",
                                           F.col("anomaly_count").alias("rule_anomalies"),
                                           F.col("high_count").alias("rule_high"))
    else:
        t = _with_counts(point_counts(df), anomalies, "rule")
    return t.select(
        "survey_id", F.lit("completed").alias("status"), "total_points",
        F.col("rule_anomalies").alias("anomaly_count"), F.col("rule_high").alias("high_count"),
        rule_score(F.col("rule_anomalies"), F.col("rule_high"), F.col("total_points")).alias("quality_score"),
        F.array(*[F.lit(r) for r in rl.rules_applied(df, sensor)]).alias("rules_applied"))


def detector_qc(df: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Per survey: detector anomaly count, rate and confidence."""
    if anomalies is None:
        t = detector_counts(df).select("survey_id", "total_points", F.col("anomaly_count").alias("det_anomalies"),
                                       F.col("high_count").alias("det_high"))
    else:
        t = _with_counts(point_counts(df), anomalies, "det")
    return t.select(
        "survey_id", "total_points", F.col("det_anomalies").alias("anomaly_count"),
        F.col("det_high").alias("high_count"),
        anomaly_rate(F.col("det_anomalies"), F.col("total_points")).alias("anomaly_rate"),
        detector_confidence(F.col("det_anomalies"), F.col("det_high"), F.col("total_points")).alias("confidence"))


def qc_summary(df: DataFrame, sensor: str, mode: str = "auto") -> DataFrame:
    """Combine rules and detector per survey.

    ``auto``: rules + detector; ``manual``: rules only; ``skip``: status
    ``skipped`` with NULL scores (the reference reports no score then).
    """
    points = point_counts(df)
    if mode == "skip":
        return points.select("survey_id", F.lit("skipped").alias("status"), "total_points",
                             F.lit(None).cast("long").alias("rule_anomalies"),
                             F.lit(None).cast("long").alias("detector_anomalies"),
                             F.lit(None).cast("long").alias("total_anomalies"),
                             F.lit(None).cast("double").alias("rule_score"),
                             F.lit(None).cast("double").alias("detector_confidence"),
                             F.lit(None).cast("double").alias("quality_score"))
    auto = mode == "auto" and "depth" in df.columns
    rc = rule_counts(df, sensor, with_detector_base=auto)
    t = rc.withColumnsRenamed({"anomaly_count": "rule_anomalies", "high_count": "rule_high"})
    if auto:
        # One aggregate pass serves the rules and the detector's unrealistic count.
        t = _detector_parts(df, t)
    elif mode == "auto":
        t = t.withColumn("det_anomalies", F.lit(0).cast("long")).withColumn("det_high", F.lit(0).cast("long"))
    if mode == "auto":
        dconf = detector_confidence(F.col("det_anomalies"), F.col("det_high"), F.col("total_points"))
    else:
        t = t.withColumn("det_anomalies", F.lit(0).cast("long")).withColumn("det_high", F.lit(0).cast("long"))
        dconf = F.lit(0.0)
    total = F.col("rule_anomalies") + F.col("det_anomalies")
    return t.select(
        "survey_id", F.lit("completed").alias("status"), "total_points",
        F.col("rule_anomalies"), F.col("det_anomalies").alias("detector_anomalies"),
        total.alias("total_anomalies"),
        rule_score(F.col("rule_anomalies"), F.col("rule_high"), F.col("total_points")).alias("rule_score"),
        dconf.alias("detector_confidence"),
        overall_score(total, F.col("total_points")).alias("quality_score"))

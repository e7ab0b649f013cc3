"""Check queries: QC rules, statistics, detector, scores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fathom.operators import detector as det
from fathom.operators import rules as rl
from fathom.operators import scoring as sc
from fathom.operators import stats as st
from fathom.operators.ordered import sequence
from fathom.operators.joins import join_null_safe
from fathom.plans.catalog import r6, register
from fathom.plans.oracle import (sql_detector, sql_duplicate_ts, sql_outliers, sql_range,
                                 sql_rule_anomalies, sql_tier)
from fathom.plans.views import view
from fathom.session import materialize_small, scratch_table_path

ANOM_COLS = ["survey_id", "idx", "rule", "type", "severity", "column", "value", "threshold"]
MBES_TYPES = ["coordinate_range", "depth_range", "beam_angle_range", "quality_range",
              "duplicate_timestamp", "depth_outlier"]

# ------------------------------------------------------------------ flagship

_QC_MBES_SQL = f"""
WITH pts AS (SELECT survey_id, count(*) AS total_points FROM soundings_mbes GROUP BY survey_id),
a AS ({sql_rule_anomalies('soundings_mbes', 'mbes')}),
c AS (SELECT survey_id, count(*) AS anomaly_count, count(*) FILTER (WHERE severity = 'high') AS high_count,
      {", ".join(f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in MBES_TYPES)}
      FROM a GROUP BY survey_id)
SELECT p.survey_id, p.total_points, coalesce(c.anomaly_count, 0) AS anomaly_count,
       coalesce(c.high_count, 0) AS high_count,
       {sql_tier("coalesce(c.anomaly_count, 0) / p.total_points", "coalesce(c.high_count, 0)", "p.total_points",
                 sc.RULE_TIERS, sc.RULE_TIER_ZERO, sc.RULE_TIER_REST)} AS quality_score,
       {", ".join(f"coalesce(c.n_{t}, 0) AS n_{t}" for t in MBES_TYPES)}
FROM pts p LEFT JOIN c ON p.survey_id = c.survey_id
"""


def qc_mbes_report(spark, sf_dir):
    """Per survey: total points, anomaly count by type, quality score."""
    s = view(spark, sf_dir, "soundings_mbes")
    c = sc.rule_counts(s, "mbes")
    score = sc.rule_score(F.col("anomaly_count"), F.col("high_count"), F.col("total_points"))
    return r6(c.select("survey_id", "total_points", "anomaly_count", "high_count", score.alias("quality_score"),
                       *[f"n_{t}" for t in MBES_TYPES]))


register("qc_mbes", _QC_MBES_SQL, ("soundings_mbes",))(qc_mbes_report)

# ---------------------------------------------------------- range rules 2.4

_RULE_VIEW = {
    "latitude": ("soundings_mbes", "mbes"), "longitude": ("soundings_mbes", "mbes"),
    "depth": ("soundings_mbes", "mbes"), "beam_angle": ("soundings_mbes", "mbes"),
    "quality": ("soundings_mbes", "mbes"), "heading": ("soundings_nav", "sbes"),
    "pitch": ("soundings_nav", "sbes"), "roll": ("soundings_nav", "sbes"),
    "velocity": ("soundings_nav", "sbes"), "elevation": ("points_lidar", "lidar"),
    "intensity": ("points_lidar", "lidar"), "classification": ("points_lidar", "lidar"),
}


def _range_query(column, vname, sensor):
    def q(spark, sf_dir):
        s = view(spark, sf_dir, vname)
        return r6(rl.range_anomalies(s, sensor, only=[column]).select(*ANOM_COLS))
    return q


for _c, (_v, _s) in _RULE_VIEW.items():
    register(f"rule_{_c}_range", sql_range(_v, _s, only=[_c]), (_v,))(_range_query(_c, _v, _s))


def _all_rules_query(vname, sensor):
    def q(spark, sf_dir):
        s = view(spark, sf_dir, vname)
        return r6(rl.rule_anomalies(s, sensor).select(*ANOM_COLS))
    return q


# Rule sets per sensor (apply_rules dispatch): mbes, sbes/singlebeam/auv, lidar, generic.
register("qc_rules_mbes", sql_rule_anomalies("soundings_mbes", "mbes"), ("soundings_mbes",))(
    _all_rules_query("soundings_mbes", "mbes"))
register("qc_rules_sbes", sql_rule_anomalies("soundings_nav", "sbes"), ("soundings_nav",))(
    _all_rules_query("soundings_nav", "sbes"))
register("qc_singlebeam", sql_rule_anomalies("soundings_nav", "singlebeam"), ("soundings_nav",))(
    _all_rules_query("soundings_nav", "singlebeam"))
register("qc_rules_auv", sql_rule_anomalies("soundings_nav", "auv"), ("soundings_nav",))(
    _all_rules_query("soundings_nav", "auv"))
register("qc_rules_lidar", sql_rule_anomalies("points_lidar", "lidar"), ("points_lidar",))(
    _all_rules_query("points_lidar", "lidar"))
register("qc_rules_generic", sql_rule_anomalies("soundings_utm", "generic"), ("soundings_utm",))(
    _all_rules_query("soundings_utm", "generic"))


@register("detect_unrealistic_depth", """
SELECT survey_id, idx, pos, depth AS value FROM (
  SELECT survey_id, idx, depth,
         row_number() OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) - 1 AS pos
  FROM soundings_mbes) s
WHERE depth < 0 OR depth > 12000""", ("soundings_mbes",))
def q_unrealistic(spark, sf_dir):
    seq = det.depth_sequence(view(spark, sf_dir, "soundings_mbes"))
    return r6(det.unrealistic_anomalies(seq).select("survey_id", "idx", "pos", "value"))


@register("parse_warnings", """
SELECT survey_id, "column", out_of_range FROM (
  SELECT survey_id, 'latitude' AS "column", count(*) FILTER (WHERE latitude < -90 OR latitude > 90) AS out_of_range FROM soundings_mbes GROUP BY survey_id
  UNION ALL SELECT survey_id, 'longitude', count(*) FILTER (WHERE longitude < -180 OR longitude > 180) FROM soundings_mbes GROUP BY survey_id
  UNION ALL SELECT survey_id, 'depth', count(*) FILTER (WHERE depth < 0 OR depth > 12000) FROM soundings_mbes GROUP BY survey_id
  UNION ALL SELECT survey_id, 'beam_angle', count(*) FILTER (WHERE beam_angle < -90 OR beam_angle > 90) FROM soundings_mbes GROUP BY survey_id
) t""", ("soundings_mbes",))
def q_parse_warnings(spark, sf_dir):
    return st.parse_warnings(view(spark, sf_dir, "soundings_mbes"), "mbes")


@register("drop_null_xyz", """
SELECT survey_id, count(*) AS kept FROM soundings_mbes
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND depth IS NOT NULL GROUP BY survey_id""",
          ("soundings_mbes",))
def q_drop_null_xyz(spark, sf_dir):
    from fathom.operators.grid import drop_null_xyz
    s = drop_null_xyz(view(spark, sf_dir, "soundings_mbes"), "depth")
    return s.groupBy("survey_id").agg(F.count(F.lit(1)).alias("kept"))


# ----------------------------------------------------------- statistics 2.6

def _stats_sql(vname, cols):
    sel = ", ".join(f"CAST(min({c}) AS DOUBLE) AS {c}_min, CAST(max({c}) AS DOUBLE) AS {c}_max, "
                    f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in cols)
    return f"SELECT survey_id, {sel} FROM {vname} GROUP BY survey_id"


def _stats_query(vname, sensor):
    def q(spark, sf_dir):
        return r6(st.sensor_statistics(view(spark, sf_dir, vname), sensor))
    return q


register("stats_mbes", _stats_sql("soundings_mbes", ["depth", "beam_angle"]), ("soundings_mbes",))(
    _stats_query("soundings_mbes", "mbes"))
register("stats_sbes", _stats_sql("soundings_nav", ["depth"]), ("soundings_nav",))(
    _stats_query("soundings_nav", "sbes"))
register("stats_lidar", _stats_sql("points_lidar", ["elevation"]), ("points_lidar",))(
    _stats_query("points_lidar", "lidar"))

_NAV_NUMERIC = ["idx", "latitude", "longitude", "depth", "heading", "pitch", "roll", "velocity", "quality"]
register("stats_generic", "\nUNION ALL\n".join(
    f"SELECT survey_id, '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM soundings_nav GROUP BY survey_id"
    for c in _NAV_NUMERIC), ("soundings_nav",))(
    lambda spark, sf_dir: r6(st.generic_statistics(view(spark, sf_dir, "soundings_nav"))))


def _meta_sql(vname, range_cols, extra=""):
    sel = ", ".join(f"CAST(min({c}) AS DOUBLE) AS {c}_min, CAST(max({c}) AS DOUBLE) AS {c}_max" for c in range_cols)
    return f"SELECT survey_id, count(*) AS total_points, {sel}{extra} FROM {vname} GROUP BY survey_id"


def _meta_query(vname, sensor):
    def q(spark, sf_dir):
        m = st.parser_metadata(view(spark, sf_dir, vname), sensor)
        cols = ["survey_id", "total_points"]
        for f in m.schema.fields:
            if f.name.endswith("_range"):
                base = f.name[:-len("_range")]
                cols += [F.col(f.name)[0].alias(f"{base}_min"), F.col(f.name)[1].alias(f"{base}_max")]
        cols += [c for c in ("mean_quality", "min_quality", "max_quality", "quality_std", "mean_intensity")
                 if c in m.columns]
        cols += [F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias(c)
                 for c in ("classification_counts", "return_number_distribution") if c in m.columns]
        return r6(m.select(*cols))
    return q


_QUAL = (", round(avg(quality), 6) AS mean_quality, CAST(min(quality) AS DOUBLE) AS min_quality, "
         "CAST(max(quality) AS DOUBLE) AS max_quality, round(stddev_samp(quality), 6) AS quality_std")
register("meta_mbes", _meta_sql("soundings_mbes", ["latitude", "longitude", "depth", "beam_angle"], _QUAL),
         ("soundings_mbes",))(_meta_query("soundings_mbes", "mbes"))
register("meta_nav", _meta_sql("soundings_nav", ["latitude", "longitude", "depth", "heading", "pitch", "roll",
                                                 "velocity"], _QUAL),
         ("soundings_nav",))(_meta_query("soundings_nav", "sbes"))
register("meta_lidar", _meta_sql("points_lidar", ["latitude", "longitude", "elevation", "intensity"],
                                 ", round(avg(intensity), 6) AS mean_intensity"
                                 + "".join(f", (SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT {c} AS v, count(*) AS n FROM points_lidar q "
                                           f"WHERE q.survey_id = points_lidar.survey_id AND {c} IS NOT NULL GROUP BY v)) AS {name}"
                                           for c, name in (("classification", "classification_counts"), ("return_number", "return_number_distribution")))),
         ("points_lidar",))(_meta_query("points_lidar", "lidar"))

register("classification_counts", """
SELECT survey_id, classification, count(*) AS count FROM points_lidar GROUP BY survey_id, classification""",
         ("points_lidar",))(lambda spark, sf_dir: st.value_counts(view(spark, sf_dir, "points_lidar"), "classification"))
register("return_number_counts", """
SELECT survey_id, return_number, count(*) AS count FROM points_lidar GROUP BY survey_id, return_number""",
         ("points_lidar",))(lambda spark, sf_dir: st.value_counts(view(spark, sf_dir, "points_lidar"), "return_number"))

register("extent", """
SELECT survey_id, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon,
       max(longitude) AS max_lon, min(depth) AS min_depth, max(depth) AS max_depth
FROM soundings_mbes GROUP BY survey_id""", ("soundings_mbes",))(
    lambda spark, sf_dir: r6(st.extent(view(spark, sf_dir, "soundings_mbes"))))

register("extent_lidar", """
SELECT survey_id, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon,
       max(longitude) AS max_lon, CAST(0 AS DOUBLE) AS min_depth, CAST(0 AS DOUBLE) AS max_depth
FROM points_lidar GROUP BY survey_id""", ("points_lidar",))(
    lambda spark, sf_dir: r6(st.extent(view(spark, sf_dir, "points_lidar"))))

# --------------------------------------------------------- scores and QC 2.6


def _rule_score_sql(vname, sensor, has_depth=True):
    return f"""
WITH pts AS (SELECT survey_id, count(*) AS total_points FROM {vname} GROUP BY survey_id),
a AS ({sql_rule_anomalies(vname, sensor, has_depth=has_depth)}),
c AS (SELECT survey_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS h FROM a GROUP BY survey_id)
SELECT p.survey_id, p.total_points, coalesce(c.n, 0) AS anomaly_count, coalesce(c.h, 0) AS high_count,
       {sql_tier("coalesce(c.n, 0) / p.total_points", "coalesce(c.h, 0)", "p.total_points",
                 sc.RULE_TIERS, sc.RULE_TIER_ZERO, sc.RULE_TIER_REST)} AS quality_score
FROM pts p LEFT JOIN c ON p.survey_id = c.survey_id"""


def _rule_score_query(vname, sensor):
    def q(spark, sf_dir):
        return r6(sc.rule_qc(view(spark, sf_dir, vname), sensor).drop("status", "rules_applied"))
    return q


register("rule_quality_score", _rule_score_sql("soundings_mbes", "mbes"), ("soundings_mbes",))(
    _rule_score_query("soundings_mbes", "mbes"))
register("rule_quality_score_nav", _rule_score_sql("soundings_nav", "sbes"), ("soundings_nav",))(
    _rule_score_query("soundings_nav", "sbes"))
register("rule_quality_score_lidar", _rule_score_sql("points_lidar", "lidar"), ("points_lidar",))(
    _rule_score_query("points_lidar", "lidar"))


def _detector_qc_sql(vname):
    return f"""
WITH pts AS (SELECT survey_id, count(*) AS total_points FROM {vname} GROUP BY survey_id),
a AS ({sql_detector(vname)}),
c AS (SELECT survey_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS h FROM a GROUP BY survey_id)
SELECT p.survey_id, p.total_points, coalesce(c.n, 0) AS anomaly_count, coalesce(c.h, 0) AS high_count,
       round(coalesce(c.n, 0) / p.total_points, 6) AS anomaly_rate,
       {sql_tier("coalesce(c.n, 0) / p.total_points", "coalesce(c.h, 0)", "p.total_points",
                 sc.DETECTOR_TIERS, None, sc.DETECTOR_TIER_REST)} AS confidence
FROM pts p LEFT JOIN c ON p.survey_id = c.survey_id"""


def _detector_qc_query(vname):
    def q(spark, sf_dir):
        return r6(sc.detector_qc(view(spark, sf_dir, vname)))
    return q


register("detector_confidence", _detector_qc_sql("soundings_mbes"), ("soundings_mbes",))(
    _detector_qc_query("soundings_mbes"))
register("detector_confidence_nav", _detector_qc_sql("soundings_nav"), ("soundings_nav",))(
    _detector_qc_query("soundings_nav"))


@register("detector_report", f"""
SELECT survey_id, total_points, anomaly_count, anomaly_rate, confidence, least(anomaly_count, 10) AS shown, greatest(0, anomaly_count - 10) AS more_anomalies,
       true AS has_yaml, 6 + 2 * least(anomaly_count, 10) + CASE WHEN anomaly_count > 10 THEN 1 ELSE 0 END AS text_lines
FROM ({_detector_qc_sql("soundings_nav")}) d""", ("soundings_nav",))
def q_detector_report(spark, sf_dir):
    """The detector's QC report per survey, rendered as JSON, YAML and text, written and read back."""
    from fathom.sinks import reports
    rep = materialize_small(reports.detector_report(view(spark, sf_dir, "soundings_nav"), "soundings_nav", "default", "2024-01-01T00:00:00Z"))
    texts = [reports.rendered(rep, f).select("survey_id", F.lit(f).alias("format"), "report") for f in ("json", "yaml", "text")]
    path = scratch_table_path(spark, f"detector-report-{uuid.uuid4().hex}")
    texts[0].unionByName(texts[1]).unionByName(texts[2]).write.partitionBy("format").parquet(path)
    back = spark.read.parquet(path)
    fields = "timestamp string, results struct<total_points:long,anomaly_count:long,confidence:double,anomaly_rate:double,anomalies:array<struct<rn:int>>>"
    r = F.from_json("report", fields)["results"]
    js = back.where("format = 'json'").select("survey_id", r["total_points"].alias("total_points"), r["anomaly_count"].alias("anomaly_count"),
                                              r["anomaly_rate"].alias("anomaly_rate"), r["confidence"].alias("confidence"),
                                              F.size(r["anomalies"]).cast("long").alias("shown"))
    lines = F.size(F.split("report", "\n")) - 1
    other = back.groupBy("survey_id").agg(F.bool_or((F.col("format") == "yaml") & F.col("report").contains("results:\n  total_points: ")).alias("has_yaml"),
                                          F.max(F.when(F.col("format") == "text", lines)).cast("long").alias("text_lines"))
    out = join_null_safe(join_null_safe(js, rep.select("survey_id", "more_anomalies"), ["survey_id"]), other, ["survey_id"])
    return r6(out)


@register("anomaly_rate", f"""
WITH pts AS (SELECT survey_id, count(*) AS total_points FROM soundings_nav GROUP BY survey_id),
a AS ({sql_detector('soundings_nav')})
SELECT p.survey_id, round(coalesce((SELECT count(*) FROM a WHERE a.survey_id = p.survey_id), 0)
       / p.total_points, 6) AS anomaly_rate FROM pts p""", ("soundings_nav",))
def q_anomaly_rate(spark, sf_dir):
    return r6(sc.detector_qc(view(spark, sf_dir, "soundings_nav")).select("survey_id", "anomaly_rate"))


def _qc_summary_sql(vname, sensor, mode="auto"):
    det_part = (f"d AS (SELECT survey_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS h "
                f"FROM ({sql_detector(vname)}) x GROUP BY survey_id)")
    return f"""
WITH pts AS (SELECT survey_id, count(*) AS total_points FROM {vname} GROUP BY survey_id),
r AS (SELECT survey_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS h
      FROM ({sql_rule_anomalies(vname, sensor)}) x GROUP BY survey_id),
{det_part},
j AS (SELECT p.survey_id, p.total_points, coalesce(r.n, 0) AS rn, coalesce(r.h, 0) AS rh,
             {"coalesce(d.n, 0)" if mode == "auto" else "0"} AS dn, {"coalesce(d.h, 0)" if mode == "auto" else "0"} AS dh
      FROM pts p LEFT JOIN r ON p.survey_id = r.survey_id LEFT JOIN d ON p.survey_id = d.survey_id)
SELECT survey_id, 'completed' AS status, total_points, rn AS rule_anomalies, CAST(dn AS BIGINT) AS detector_anomalies,
       CAST(rn + dn AS BIGINT) AS total_anomalies,
       {sql_tier("rn / total_points", "rh", "total_points", sc.RULE_TIERS, sc.RULE_TIER_ZERO, sc.RULE_TIER_REST)} AS rule_score,
       {sql_tier("dn / total_points", "dh", "total_points", sc.DETECTOR_TIERS, None, sc.DETECTOR_TIER_REST)
        if mode == "auto" else "CAST(0.0 AS DOUBLE)"} AS detector_confidence,
       round(CASE WHEN total_points = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - (rn + dn) / total_points)) END, 6)
         AS quality_score
FROM j"""


register("qc_summary", _qc_summary_sql("soundings_mbes", "mbes"), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(sc.qc_summary(view(spark, sf_dir, "soundings_mbes"), "mbes", "auto")))
register("qc_summary_manual", _qc_summary_sql("soundings_nav", "sbes", "manual"), ("soundings_nav",))(
    lambda spark, sf_dir: r6(sc.qc_summary(view(spark, sf_dir, "soundings_nav"), "sbes", "manual")))
register("qc_summary_skip", """
SELECT survey_id, 'skipped' AS status, count(*) AS total_points, CAST(NULL AS BIGINT) AS rule_anomalies,
       CAST(NULL AS BIGINT) AS detector_anomalies, CAST(NULL AS BIGINT) AS total_anomalies,
       CAST(NULL AS DOUBLE) AS rule_score, CAST(NULL AS DOUBLE) AS detector_confidence,
       CAST(NULL AS DOUBLE) AS quality_score
FROM points_lidar GROUP BY survey_id""", ("points_lidar",))(
    lambda spark, sf_dir: sc.qc_summary(view(spark, sf_dir, "points_lidar"), "lidar", "skip"))

register("overall_quality_score", f"""
SELECT survey_id, quality_score FROM ({_qc_summary_sql('soundings_nav', 'sbes')}) q""", ("soundings_nav",))(
    lambda spark, sf_dir: r6(sc.qc_summary(view(spark, sf_dir, "soundings_nav"), "sbes", "auto")
                             .select("survey_id", "quality_score")))


@register("anomaly_counts_by_type", f"""
SELECT survey_id, source, type, severity, count(*) AS n FROM (
  SELECT survey_id, 'rule' AS source, type, severity FROM ({sql_rule_anomalies('soundings_mbes', 'mbes')}) r
  UNION ALL SELECT survey_id, 'detector', type, severity FROM ({sql_detector('soundings_mbes')}) d) u
GROUP BY survey_id, source, type, severity""", ("soundings_mbes",))
def q_counts_by_type(spark, sf_dir):
    s = view(spark, sf_dir, "soundings_mbes")
    u = rl.rule_anomalies(s, "mbes").unionByName(det.detector_anomalies(s))
    return u.groupBy("survey_id", "source", "type", "severity").agg(F.count(F.lit(1)).alias("n"))


register("duplicate_timestamp_rule", sql_duplicate_ts("points_lidar"), ("points_lidar",))(
    lambda spark, sf_dir: r6(rl.duplicate_timestamp_anomalies(view(spark, sf_dir, "points_lidar"))
                             .select(*ANOM_COLS)))


@register("duplicate_coordinate_rule", """
SELECT survey_id, latitude, longitude, count(*) AS n,
       CAST(least(1.0, count(*) / 50.0) AS DOUBLE) AS confidence
FROM soundings_nav WHERE latitude IS NOT NULL AND longitude IS NOT NULL
GROUP BY survey_id, latitude, longitude HAVING count(*) > 10""", ("soundings_nav",))
def q_dup_coord(spark, sf_dir):
    g = det.duplicate_coordinate_groups(view(spark, sf_dir, "soundings_nav"))
    return r6(g.select("survey_id", "latitude", "longitude", "n",
                       F.least(F.lit(1.0), F.col("n") / 50.0).alias("confidence")))


register("depth_outlier_rule", sql_outliers("soundings_mbes"), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(rl.depth_outlier_anomalies(view(spark, sf_dir, "soundings_mbes"))
                             .select(*ANOM_COLS)))

# --------------------------------------------------------------- windows 2.8


@register("depth_jump", """
SELECT survey_id, idx, pos, CASE WHEN abs(diff) > 200 THEN 'high' ELSE 'medium' END AS severity,
       round(diff, 6) AS value, round(least(1.0, abs(diff) / 200.0), 6) AS confidence
FROM (SELECT survey_id, idx, depth - lag(depth) OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) AS diff,
             row_number() OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) - 1 AS pos
      FROM soundings_mbes) s
WHERE diff > 100 OR diff < -100""", ("soundings_mbes",))
def q_depth_jump(spark, sf_dir):
    seq = det.depth_sequence(view(spark, sf_dir, "soundings_mbes"))
    return r6(det.jump_anomalies(seq).select("survey_id", "idx", "pos", "severity", "value", "confidence"))


register("detector", sql_detector("soundings_mbes"), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(det.detector_anomalies(view(spark, sf_dir, "soundings_mbes"))
                             .select("survey_id", "idx", "pos", "type", "severity", "value", "confidence")))

register("detector_nav", sql_detector("soundings_nav"), ("soundings_nav",))(
    lambda spark, sf_dir: r6(det.detector_anomalies(view(spark, sf_dir, "soundings_nav"))
                             .select("survey_id", "idx", "pos", "type", "severity", "value", "confidence")))


@register("sort_by_time", """
SELECT survey_id, idx, row_number() OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) - 1 AS pos
FROM soundings_nav""", ("soundings_nav",))
def q_sort_by_time(spark, sf_dir):
    s = view(spark, sf_dir, "soundings_nav").select("survey_id", "idx", "timestamp")
    return sequence(s, ["survey_id"], ["timestamp", "idx"]).select("survey_id", "idx", "pos")


@register("duplicate_flag_window", """
SELECT survey_id, idx, count(*) OVER (PARTITION BY survey_id, timestamp) > 1 AS is_duplicate FROM points_lidar""",
          ("points_lidar",))
def q_dup_flag(spark, sf_dir):
    return rl.duplicate_flags(view(spark, sf_dir, "points_lidar"), ["timestamp"])


# ------------------------------------------------- unions and top-k 2.9

_RULE_ORDER_SQL = ("CASE rule " + " ".join(
    f"WHEN '{rl.rule_name(r)}' THEN {i}" for i, r in enumerate(rl.SENSOR_RULES["mbes"])) + " END")


@register("union_anomalies", f"""
SELECT survey_id, source, count(*) AS n FROM (
  SELECT survey_id, 'rule' AS source FROM ({sql_rule_anomalies('soundings_mbes', 'mbes')}) r
  UNION ALL SELECT survey_id, 'detector' FROM ({sql_detector('soundings_mbes')}) d) u
GROUP BY survey_id, source""", ("soundings_mbes",))
def q_union(spark, sf_dir):
    s = view(spark, sf_dir, "soundings_mbes")
    u = rl.rule_anomalies(s, "mbes").unionByName(det.detector_anomalies(s))
    return u.groupBy("survey_id", "source").agg(F.count(F.lit(1)).alias("n"))


@register("top_anomalies", f"""
SELECT survey_id, idx, rule, type, severity, "column", value, threshold, CAST(rn AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY {_RULE_ORDER_SQL}, idx NULLS FIRST) AS rn
  FROM ({sql_rule_anomalies('soundings_mbes', 'mbes')}) a) t
WHERE rn <= 10""", ("soundings_mbes",))
def q_top(spark, sf_dir):
    from fathom.sinks.reports import top_anomalies
    s = view(spark, sf_dir, "soundings_mbes")
    t = top_anomalies(rl.rule_anomalies(s, "mbes"), "mbes", 10)
    return r6(t.select(*ANOM_COLS, "rn"))
